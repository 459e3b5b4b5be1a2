import hashlib
import math
import re

from corpus import ODD, frame, same_on_clash
from pyspark.sql import functions as F

from txnrisk.llm import secret_scan as ss

ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww](?:[Oo][Rr])?[Dd])|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KEY = "q7Zk2Lw9Xv4Tb8Nd1Rf6Yp3Hs5"
TEXTS = [
    "token = 'abcdefghijkl' and Token: abcdefghijk", "password: token=abcdefghijklmnop", "secret: password: abcdefghijklmnop",
    "API_KEY=" + "A" * 12 + " apikey='x'", "AKIA" + "A" * 14 + " AKIA" + "A" * 13 + " xAKIAAKIA" + "Z9" * 8,
    "deadbeefdeadbeef deadbeefdeadbee 0123456789abcdef0", "é日😀 " + KEY + " " + KEY.lower(),
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" + KEY + "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "123e4567-e89b-12d3-a456-426614174000",
    KEY + "EXAMPLE", "/usr-local/share-files/some-long-path", "internationalisationwords"]


def base(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m.group(2)) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 16])


def entropy(t):
    out = []
    for m in re.finditer(ss.CANDIDATE, t):
        c = m.group()
        if re.search("|".join(ss.ALLOW), c):
            continue
        kind, bits = next((i, b) for i, (_, p, b) in enumerate(ss.CLASSES) if re.search(p, c))
        covered = set()
        for i in range(len(c) - ss.WINDOW + 1):
            w = c[i:i + ss.WINDOW]
            h = -sum(w.count(x) / len(w) * math.log2(w.count(x) / len(w)) for x in set(w))
            if h >= bits:
                covered.update(range(i, i + ss.WINDOW))
        runs = []
        for x in sorted(covered):
            if runs and runs[-1][1] == x:
                runs[-1][1] = x + 1
            else:
                runs.append([x, x + 1])
        out += [(m.start() + a, 3 + kind, m.start() + b) for a, b in runs]
    return out


def test_spans_match_brute_force(spark):
    docs = frame(spark, [(i, t) for i, t in enumerate(TEXTS)] + ODD)
    got = same_on_clash(lambda d: ss.scan(d).select("text", "spans"), docs)
    for text, spans in got:
        assert [tuple(s) for s in spans] == sorted(base(text) + entropy(text)), text
    assert any(s[1] > 2 for _, spans in got for s in spans)


def test_allow_list_keeps_base_spans(spark):
    got = ss.scan(frame(spark, [(1, "deadbeef" * 3 + "EXAMPLE")])).first()
    assert [tuple(s) for s in got.spans] == [(0, 2, 24)]


def test_redaction(spark):
    docs = frame(spark, [(1, "a token = 'abcdefghijkl' b " + "deadbeef" * 2 + " c"), (2, "clean"), (3, None)])
    out = ss.scan(docs).select("doc_id", ss.redact(F.col("text"), F.col("spans")).alias("t")).orderBy("doc_id").collect()
    assert [r.t for r in out] == ["a [SECRET]' b [SECRET] c", "clean", ""]


def test_many_matches_and_long_runs(spark):
    text = ("deadbeefdeadbeef " * 1500) + KEY * 200
    spans = ss.scan(frame(spark, [(1, text)])).first().spans
    assert [tuple(s) for s in spans if s[1] < 3] == base(text)
    assert [tuple(s) for s in spans if s[1] >= 3] == entropy(text)


def test_empty_table_and_digest(spark):
    assert ss.scan(frame(spark, [])).collect() == []
    r = ss.scan(frame(spark, [(1, "deadbeef" * 2)])).select(F.sha2(ss.joined(F.col("spans")), 256).alias("h")).first()
    assert r.h == hashlib.sha256(b"hex:0:16").hexdigest()


def test_long_hyphened_texts(spark):
    """No pattern may recurse by the text's length."""
    texts = ["ab-" * 60_000, "ab-" * 60_000 + "ab", "a" * 200_000, "x/" * 50_000 + KEY, "token=" + "a-" * 60_000, "a--b" * 9000]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in ss.scan(frame(spark, [*enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        assert got[i] == sorted(base(t) + entropy(t)), t[:20]
