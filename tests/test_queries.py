"""Every registered query against its SQL on the smallest tables; those without SQL against their
definitions, row by row in plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

import __spark_entry__ as entry
from compare import SF, connect, differences
from plumbline.functions import bytefeatures as BF
from plumbline.functions import textnum
from plumbline.plans import registry


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def features(spark, part=None):
    at, width = (0, BF.N_FEATURES) if part is None else BF.part_of(part)
    return {k: None if t is None else BF.features(t.encode())[at : at + width] for k, t in texts(spark).items()}


def same_vectors(rows, want):
    assert {k for k, _ in rows} == set(want)
    for k, v in rows:
        assert (v is None) == (want[k] is None) and (v is None or v == pytest.approx(want[k].tolist(), abs=1e-5)), k


def compressed(spark, rows):
    held = texts(spark)
    assert len(rows) == len(held)
    for k, level, n, sha in rows:
        c = zlib.compressobj(level, zlib.DEFLATED, -15)
        raw = c.compress(held[k].encode()) + c.flush()
        assert (level, n, sha) == (k % 9 + 1, len(raw), hashlib.sha256(raw).hexdigest())


def bit_runs(spark, rows):
    got = {}
    for k, share in rows:
        got.setdefault(k, []).append(share)
    same_vectors(list(got.items()), features(spark, "bit_runs"))


def numbers(spark, rows):
    want = Counter()
    for k, t in texts(spark).items():
        for line in (t or "").split("\n"):
            if not re.search(textnum.IGNORE, line):
                for pattern in (textnum.URL, textnum.GEOMETRY, textnum.HEX):
                    line = re.sub(pattern, " ", line)
                want.update((k, m.group(1)) for m in re.finditer(textnum.NUMBER, line, re.A))
    assert {(k, token): n for k, token, n in rows} == dict(want)


def generated(spark, rows):
    again = {r["chunk_id"]: (r["fam"], r["sha256"]) for r in registry.QUERIES["sc13_generated_content"](spark, SF).repartition(3).collect()}
    assert {k: (f, s) for k, f, s in rows} == again and Counter(f for _, f, _ in rows) == {f"f{i}": 10 for i in range(7)}
    assert len({s for _, _, s in rows}) == 70


def normal(spark, rows):
    for _, mean, sd, *p in rows:
        cdf = [0.0, *(0.5 * (1 + math.erf((c - mean) / sd / math.sqrt(2))) for c in (49, 50, 51)), 1.0]
        assert p == pytest.approx([b - a for a, b in zip(cdf, cdf[1:], strict=False)])


def probabilities(spark, rows):
    by = {}
    for k, prediction, c, p in rows:
        by.setdefault(k, {})[c] = p
        assert 0 <= p <= 1
    best = {k: prediction for k, prediction, _, _ in rows}
    assert all(sum(v.values()) == pytest.approx(1) and v[best[k]] == max(v.values()) for k, v in by.items())


def baselines(spark, rows):
    y = [r["label"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert [r[1] for r in sorted(rows, key=lambda r: r[1])] == list(range(len(rows))) and len(rows) == 7
    assert all(0 <= a <= 1 for _, _, a in rows) and dict((n, a) for n, _, a in rows)["majority"] <= max(Counter(y).values()) / len(y) * 2


def orbits(spark, rows):  # radii of medium orbits, about 26,560 km
    assert len(rows) == 1000 and all(2.4e7 < math.dist((0, 0, 0), r[1:4]) < 2.9e7 for r in rows)


def lines(spark, rows):
    names = [r["n_name"] for r in spark.read.parquet(f"{SF}/nation.parquet").orderBy("n_nationkey").collect()]
    want = [hashlib.sha256(f"{n}{i}".encode()).hexdigest() for i in range(400) for n in names]
    got = [x for _, x in sorted(rows)]
    assert 0 < len(got) < len(want) and got == want[: len(got)]


def shares(spark, rows):
    assert rows and all(0 <= x <= 1 for r in rows for x in r if isinstance(x, float))


CHECKS = {
    "sc2_compress": compressed, "sc6_bit_runs": bit_runs, "sc9_alignment_stats": lambda s, r: same_vectors(r, features(s, "align_stats")), "sc10_alignment_histograms": lambda s, r: same_vectors(r, features(s, "align_hist")),
    "sc12_feature_vector": lambda s, r: same_vectors(r, features(s)), "sc13_generated_content": generated, "sc19_number_tokens": numbers, "sc26_orbit_propagation": orbits,
    "sc29_sat_features": lambda s, r: [None for _, f in r if not (len(f) == 28 and all(map(math.isfinite, f))) and pytest.fail()], "bs11_operating_characteristics": normal,
    "ml1_trivial_baselines": baselines, "ml2_extended_baselines": lambda s, r: ([x[0] for x in sorted(r)] == ["expanded", "frozen"] and sorted(r)[0][2] >= sorted(r)[1][2]) or pytest.fail(),
    "ml3_main_model": shares, "ml4_estimator_registry": lambda s, r: ([x[0] for x in sorted(r)] == ["boosted", "forest", "logistic", "tree"] and shares(s, r) is None) or pytest.fail(),
    "ml5_recipe_search": lambda s, r: (sum(x[3] for x in r) == 1 and shares(s, r) is None) or pytest.fail(), "ml8_probabilities": probabilities, "rd9_document_gate": lambda s, r: all(n > 0 for _, n in r) or pytest.fail(), "src10_truncated_stream": lines,
}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLE_SQL:
        assert differences(df, con, registry.ORACLE_SQL[name]) == []
    else:
        CHECKS[name](spark, [tuple(r) for r in df.collect()])


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 1


def test_registry_is_whole():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
