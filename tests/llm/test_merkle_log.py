import hashlib
import random
import zlib

import pytest
from corpus import ODD, clashing, frame, rows
from pyspark.sql import functions as F

from txnrisk.llm import merkle_log as ml
from txnrisk.llm.queries import op11_merkle_log

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(UPPER, UPPER.lower())


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc, source, lang, n, text):
    return H(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc, source, lang, n, text)])


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][k:k + 16]) for k in range(0, len(out[-1]), 16)])
    return out


def climb(tree, i):
    for level in tree[:-1]:
        run = level[i - i % 16:i - i % 16 + 16]
        yield run[:i % 16], run[i % 16 + 1:]
        i //= 16


def brute(data):
    """Plain trees in memory; ``data``: (doc_id, text, lang, source, n_chars)."""
    key = lambda x: (x is not None, (x or "").encode())
    sources = sorted({d[3] for d in data}, key=key)
    mine = {s: sorted(((d[0] is not None, d[0] or 0, leaf(d[0], d[3], d[2], d[4], d[1]), d) for d in data if d[3] == s),
                      key=lambda x: x[:3]) for s in sources}
    trees = {s: levels([x[2] for x in mine[s]]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, (_, _, own, d) in enumerate(mine[s]):
            fold = own
            if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 0:
                fold = leaf(d[0], d[3], d[2], d[4], d[1] and d[1].translate(LOWER))
            proof = ""
            for left, right in [*climb(trees[s], i), *climb(top, k)]:
                proof += "".join(left + right)
                fold = H(*left, fold, *right)
            out.append((d[0], own, trees[s][-1][0], top[-1][0], H(proof), fold, fold == top[-1][0]))
    return sorted(out, key=repr)


def run(df):
    return ml.verify(df, F.translate("text", UPPER, UPPER.lower()), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)


def held(spark, df):
    got = rows(run(df))
    assert got == brute([tuple(r) for r in df.collect()])
    return got


def test_places_in_postorder():
    for n in [1, 2, 15, 16, 17, 31, 255, 256, 257, 4095, 4096, 4097, 5000]:
        order, done = [], 0

        def walk(level, i):
            if level:
                for j in range(16 * i, min(16 * i + 16, ml.width(n, level - 1))):
                    walk(level - 1, j)
            order.append((level, i))
        walk(ml.height(n), 0)
        assert [ml.position(n, *x) for x in order] == list(range(len(order)))


@pytest.mark.parametrize("n", [1, 16, 17, 256, 257, 300])
def test_builders_write_postorder(n):
    digests = [H(str(k)) for k in range(n)]
    nodes = {}
    for first in range(0, n, ml.SPAN):
        nodes.update({(lv, i): d for lv, i, d, _ in ml.completed(n, 0, first, digests[first:first + ml.SPAN])})
    tree = levels(digests)
    assert nodes == {(lv, i): d for lv, level in enumerate(tree[:3]) for i, d in enumerate(level)}


def test_odd_rows_and_clashing_columns(spark):
    df = frame(spark, ODD)
    got = held(spark, df)
    assert len(got) == len(ODD)
    assert rows(run(clashing(df))) == got
    assert rows(run(df.limit(0))) == []
    held(spark, df.limit(1))


def test_null_fields_differ_from_empty_ones(spark):
    got = held(spark, spark.createDataFrame([(1, None, None, None, None), (1, "", "", "", 0)], df_schema()))
    assert len({r[1] for r in got}) == 2


def df_schema():
    return "doc_id long, text string, lang string, source string, n_chars long"


def test_deep_and_hot_sources(spark):
    rng = random.Random(3)
    data = [(i, rng.choice(["Some Text", "plain", None, "É A", "x" * 3000]), "en", None if i % 97 == 0 else "hot" if i % 3 else f"s{i % 400}", i)
            for i in range(9000)]
    held(spark, spark.createDataFrame(data + data[:5], df_schema()).repartition(5))


def test_tampering_is_seen(spark):
    got = {r[0]: r[-1] for r in rows(op11_merkle_log(spark, "/root/testdata/sf0.001"))}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert got == {i: not (zlib.crc32(str(i).encode()) % 5 == 0 and (t or "").translate(LOWER) != (t or "")) for i, t in docs.items()}
    assert not all(got.values())
