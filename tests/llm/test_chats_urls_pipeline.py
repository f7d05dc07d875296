"""Chat formatting, URL filters, the pipeline, and the queries with SQL."""

import hashlib
import os
import random

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from compare import SF, connect, differences
from plumbline.llm import chat, queries, urls

CONTROL = ["<|im_end|>", "<|im_start|>assistant<|im_sep|>x", "<\\|", "<\\\\|x<||", "a<|", "", "\n", "  lead", "trail \n", "🙂<|🙂", "plain words here.", None, "é" * 50, "<", "|", "long " * 3000]


@pytest.mark.parametrize("text", [t for t in CONTROL if t is not None])
def test_escape_round_trip(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


def test_conversations_round_trip(spark):
    r = random.Random(1)
    rows = [(c, t, r.choice(["user", "assistant", "system", "a\nb", None, "<|x"]), r.choice(CONTROL)) for c in range(30) for t in range(r.randint(1, 7))]
    rows += [(None, 0, "assistant", "of no conversation"), (99, 1, "user", "same"), (99, 1, "user", "same"), (99, None, "user", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(1)).withColumn("mask", F.lit(2)).repartition(4)
    got = {x["conv_id"]: x for x in chat.report(df).collect()}
    by = {}
    for c, t, role, text in rows + chat.PLANTED:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, role, x in turns if role == "assistant")
        sha = hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_masked_tokens_are_the_assistant_texts():
    turns = [[("user", "hi there"), ("assistant", "hello, <|im_end|> friend"), ("assistant", "")], [], [("assistant", "ends with <"), ("assistant", "\\| begins so")], [("user", "é"), ("assistant", "🙂 é")]]
    f = chat.format_conversations(turns, chat.encoder())
    assert chat.loss_texts(f.texts, f.offsets, f.mask, f.ends) == [["hello, <|im_end|> friend"], [], ["ends with <", "\\| begins so"], ["🙂 é"]]
    assert 0 < f.mask.sum() < len(f.ids) == len(f.mask) == f.ends[-1]


def test_ids_are_the_tokenizers_of_the_whole_text():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.add_special_tokens([chat.START, chat.SEP, chat.END])
    f = chat.format_conversations([[(role, x or "") for role in ("user", "assistant") for x in CONTROL]], chat.encoder())
    want = t.encode(f.texts[0], add_special_tokens=False)
    assert f.ids.tolist() == want.ids and list(map(tuple, f.offsets.tolist())) == want.offsets


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(none).count() == 0
    assert [r["conv_id"] for r in chat.report(none).collect()] == [-1]


URLS = [
    "http://A.Example.COM/en/7?x", "https://example.com/en/8", "http://example.net/de/8", "http://x.net/de/9#a", "http://org/es/", "http://norg/es/", "http://a.org/es", "ftp://com/en/", "no scheme", None, "://", "http://", "http://h", "http://h?x=/en/",
    "http://h#://z", "http://a.b.c.d.e.f.com/en/x/y/z", "http://example.com/en/", "http://com./en/", "http://" + "a." * 300 + "com/en/" + "x" * 3000, "http://example.com/en/7", "http://example.com/en/7",
]


def brute(url):
    rest = "" if url is None or "://" not in url else url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fit = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, rule string, verdict string")
    got = {r["page_id"]: tuple(r)[1:] for r in urls.judge(pages, urls.rule_table(spark, urls.RULES)).collect()}
    assert got == {i: brute(u) for i, u in enumerate(URLS)}
    none = urls.judge(pages, urls.rule_table(spark, urls.RULES).where("false")).collect()
    assert len(none) == len(URLS) and {r["verdict"] for r in none} == {"allow"}
    assert urls.judge(pages.where("false"), urls.rule_table(spark, urls.RULES)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_with_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLE_SQL[name]) == []


def test_ten_operators_are_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 11))


@pytest.fixture
def small(spark, docs, texts, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, texts[10])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_keep_columns_and_clean_documents(spark, docs, texts, small):
    held, kept = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, held, small)
        assert out.columns == held.columns, name
        out.write.parquet(f"{small}/{name}")
        held = spark.read.parquet(f"{small}/{name}")
        kept.append({r["doc_id"] for r in held.select("doc_id").collect()})
    language, lines, near, clean = kept
    assert language == {i for i, t in enumerate(texts) if any(c.isalpha() for c in t or "")}
    assert lines == language
    assert near < lines and {2, 4} <= near and not near & {60, 61, 62}
    assert near - clean == {10}
    packed = corpus_pipeline.STAGES[-1][1](spark, held, small)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == clean


def test_without_labels_only_texts_without_letters_go(spark, docs, texts):
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    out = corpus_pipeline.language_id(spark, unlabelled, "")
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.select("doc_id").collect()) == [i for i, t in enumerate(texts) if any(c.isalpha() for c in t or "")]


def test_stages_keep_columns_by_value(spark, texts, small):
    rows = [(i, t, "en", f"own {i}", i * 3, i * 5, "a", "b", "c") for i, t in enumerate(texts)]
    held = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, n_lines int, n_dropped int, lang_pred string, hash string, places string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = stage(spark, held, small)
        assert [c for c, _ in held.dtypes] == held.columns and len(held.columns) == 9, name
        held.write.parquet(f"{small}/value_{name}")
        held = spark.read.parquet(f"{small}/value_{name}")
    got = held.collect()
    assert len(got) > 20
    for r in got:
        assert tuple(r)[2:] == ("en", f"own {r['doc_id']}", r["doc_id"] * 3, r["doc_id"] * 5, "a", "b", "c")


def test_different_texts_of_one_doc_id_stay(spark):
    words = lambda a, n=40: " ".join(f"{a}{x}{y}" for x in "abcdefgh" for y in "klmno"[: n // 8])
    rows = [(1, words("one")), (1, words("two")), (1, words("one")), (2, words("two")), (3, words("three")), (None, words("three")), (None, words("four")), (None, words("four")), (4, None), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0), r["text"] or "") for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == sorted([(1, words("one")), (1, words("two")), (3, words("three")), (0, words("four")), (4, "")])


def test_near_dedup_finds_the_groups_of_exact_similarity(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    sets = {}
    for i, t in texts.items():
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    up = {i: i for i in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in texts:
        for j in texts:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").select("doc_id").collect()}
    assert got == {i for i in texts if root(i) == i} and len(got) < len(texts)


def test_run_is_the_stages_in_turn(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]


def test_library_stands_without_this_subpackage():
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    for folder, _, names in os.walk(os.path.join(root, "plumbline")):
        if os.path.basename(folder) == "llm":
            continue
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(folder, n)) as f:
                    assert "plumbline.llm" not in f.read(), n


def test_texts_go_to_python_in_small_batches(spark):
    import pyarrow as pa
    from plumbline.llm.common import TEXT_ROWS

    import corpus_pipeline

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        docs = spark.range(50).selectExpr("id as doc_id", "'some words here' as text", "cast(null as string) as lang")
        assert corpus_pipeline.language_id(spark, docs, "").count() == 50
        rows = spark.range(0, 3000, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([len(b)])], names=["n"]) for b in batches), "n long").collect()
        assert sum(r["n"] for r in rows) == 3000 and max(r["n"] for r in rows) <= TEXT_ROWS
    finally:
        spark.conf.set(name, before)
