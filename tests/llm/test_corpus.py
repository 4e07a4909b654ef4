"""Corpus operators against brute force, on small tables with awkward rows."""

import hashlib
import json
import os
import random
import re
import time
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from gridlore.llm import binary_output, embedding_dedup, exact_dedup, jaccard_join, langid, mixing, packing, pii, quality, quotes
from gridlore.llm.common import Workspace, carried, connected_components, lean
from gridlore.llm.queries import QUERIES
from gridlore.llm.tokens import Encoder, tokenizer_path

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["a \n b  \n\t x", "don't I'LL  it's 12345 ½ ²", "é ́x İstanbul ſ ß ẞ", "<|endoftext|> x<|endoftext|>y <|startoftext|>", "日本 語テスト 🙂🙂", "", "   ",
       "\n\n a", "a\x85b\x1cc d", "x" * 500 + " " + "!?" * 100, "Œuvre ŒUVRE ÀÉ×÷ªº", "a \n b c"]


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], schema) if rows else spark.createDataFrame([], schema)


def clashing(df):
    """The table with further columns whose names operators use inside."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(9).alias(c) for c in ("k", "key", "rep", "n", "grp", "digest", "best", "copies", "p", "unit", "cells", "component", "label")])


class Union(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            self[x] = self[self[x]]
            x = self[x]
        return x

    def union(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self[max(a, b)] = min(a, b)


def near_texts(n=120, seed=5):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(900)]
    out = []
    for _ in range(n // 12):
        base = [rng.choice(words) for _ in range(rng.randint(30, 160))]
        for _ in range(12):
            t = list(base)
            for _ in range(rng.randint(0, 5)):
                t[rng.randrange(len(t))] = rng.choice(words)
            out.append(" ".join(t))
    return [*out, *out[:5], "A b", "a\tB", "a b c", "", None, "  \n", "one two three four", "ONE two  three\nfour", "x " * 400]


def sets_of(text, width):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute_components(texts, width, threshold):
    sets, uf = {i: sets_of(t, width) for i, t in texts.items()}, Union()
    for i in texts:
        uf.find(i)
        for j in texts:
            a, b = sets[i], sets[j]
            if j < i and a and b and 100 * len(a & b) >= threshold * len(a | b):
                uf.union(i, j)
    return {i: (len(sets[i]), uf.find(i)) for i in texts}


@pytest.mark.parametrize("width, threshold, sizes", [(4, 85, {}), (5, 80, {}), (4, 85, {"CHUNK": 4, "SMALL_BLOCK": 12, "TINY_BLOCK": 3, "PAIR_BLOCK": 5}),
                                                     (4, 85, {"HOT_COUNT": 2, "CHUNK": 3, "SMALL_BLOCK": 2, "TINY_BLOCK": 2}), (4, 85, {"BROADCAST_IDS": 0})])
def test_jaccard(spark, monkeypatch, width, threshold, sizes):
    for k, v in sizes.items():
        monkeypatch.setattr(jaccard_join, k, v)
    texts = dict(enumerate(near_texts(), 100))
    df = clashing(table(spark, [(i, t) for i, t in texts.items()]).repartition(5))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df, width=width, threshold=threshold).collect()}
    assert got == brute_components(texts, width, threshold)


def test_jaccard_edges(spark):
    rows = [(1, "a b c d e"), (1, "other words entirely here now"), (2, "a b c d e"), (3, "other words entirely here now"), (None, "a b c d e"), (4, None)]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(table(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 2, 1), (None, 2, None), (4, 0, 4)], key=str)
    assert jaccard_join.jaccard_components(table(spark, [])).count() == 0
    kept = jaccard_join.one_row_of_each(clashing(table(spark, rows[2:])))
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [2, 3, 4] and "rep" in kept.columns


def test_jaccard_filters():
    """What passes the orders' filters holds every link, and both ways of counting agree."""
    sketch = np.zeros(2 << 20, np.int32)
    sets = [np.array(sorted(s), np.uint64) for s in ({hash(x) & (1 << 64) - 1 for x in sets_of(t, 4)} for t in near_texts()) if s]
    jaccard_join._count(sketch, sets)
    orders, threshold, n = jaccard_join.Orders(sketch), 85, len(sets)
    prefixes = []
    for s in sets:
        keys = list(orders.keys(s, orders.count(s)))
        prefixes.append([s[jaccard_join._first(k, jaccard_join.prefix_length(len(s), threshold))] for k in keys])
    i, j = np.triu_indices(n, 1)
    raw = [b"".join(p.astype("<u4").tobytes() for p in x[1:]) for x in prefixes]
    got = jaccard_join.sharing([raw[x] for x in i], [raw[x] for x in j])
    want = np.array([all(len(np.intersect1d(p, q)) for p, q in zip(prefixes[x][1:], prefixes[y][1:], strict=True)) for x, y in zip(i, j, strict=True)])
    both = np.array([len(np.intersect1d(sets[x], sets[y])) for x, y in zip(i, j, strict=True)])
    linked = 100 * both >= threshold * (np.array([len(s) for s in sets])[i] + np.array([len(s) for s in sets])[j] - both)
    assert (got == want).all() and linked.sum() > 50 and (got | ~linked).all() and got.sum() < len(got) / 2
    rng = np.random.default_rng(0)
    for share in (0.001, 0.9):
        may = rng.random((n, n)) < share
        a, b, counts = jaccard_join.passing_counts(sets, may, 0)
        assert len(a) == np.triu(may, 1).sum() and counts.tolist() == [len(np.intersect1d(sets[x], sets[y])) for x, y in zip(a, b, strict=True)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 400)] + [(500, 500 + i) for i in range(50)] + [(7, 7)]
    uf = Union()
    for a, b in edges:
        if a != b:
            uf.union(a, b)
    got = connected_components(Workspace(spark, "t"), spark.createDataFrame(edges, "a long, b long"))
    assert {r["id"]: r["component"] for r in got.collect()} == {v: uf.find(v) for v in list(uf)}


def luhn(s):
    return sum(int(x) if k % 2 == 0 else sum(divmod(2 * int(x), 10)) for k, x in enumerate(reversed(s))) % 10 == 0


RULES = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
         ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
         ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
         ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15)]


def brute_pii(text):
    found = [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, p, ok) in enumerate(RULES) for m in re.finditer(p, text) if ok(m.group())]
    return ",".join(x[2] for x in sorted(found))


PII_TEXTS = ["mail é🙂 a@b.c+d@e.f and x.y@z or _@q-.r..s", "ip 1.2.3.4.5.6.7.8 and 256.1.1.1 or 0001.02.3.255", "card 4111 1111 1111 1111 and 4111-1111-1111-1112",
             "call +49 (30) 1234-567. or +1 2 or +12345678901234567", "", None, "a" * 20_000 + "@" + "b.c" * 3000, "1 " * 3000 + "1" * 30_000, "+5" + " " * 5000 + "x",
             "@@@ a@b. c@d.e", "pay 4111111111111111 to bank account DE89 3704 0044 0532 0130 00 now", "ssn 123-45-6789; part 123-45-6789-0", "😀+4912345678😀1.1.1.1"]


def test_pii(spark, tmp_path):
    rng = random.Random(1)
    texts = PII_TEXTS + ["".join(rng.choice("01239.-+@ ab()") for _ in range(200)) for _ in range(150)]
    clashing(table(spark, [(i, t) for i, t in enumerate(texts)])).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in pii.op2(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        want = brute_pii(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (i, want, got[i]["spans"])
        assert set(filter(None, want.split(","))) <= set(got[i]["spans"].split(","))
        assert got[i]["n_card"] == want.count("card:")
    assert "iban:37:64" in got[10]["spans"] and "national_id:4:15" in got[11]["spans"] and got[11]["spans"].count("national_id") == 1
    clean = pii.redact(table(spark, [(1, "x a@b.cd y 1.1.1.1"), (2, None), (3, "no account 4111 1111 1111 1112")])).orderBy("doc_id").collect()
    assert [r["text"] for r in clean] == ["x <email> y <ip>", None, "no account 4111 1111 1111 1112"]
    assert pii.find_pii(table(spark, [])).count() == 0


def test_secrets(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    texts = [f'token = "{key}" then', f"a commit {key} of code", "token = aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1", "Bearer " + "aB3xZ9" * 5 + "qLmN7==", "token " + "x" * 60_000,
             "the token ring network connects twenty-seven-hundred-and-some machines"]
    got = {r["doc_id"]: [(x["kind"], x["start"], x["end"]) for x in r["found"]] for r in pii.find_pii(table(spark, list(enumerate(texts)))).collect()}
    assert got == {0: [("secret", 9, 49)], 1: [], 2: [], 3: [("secret", 7, 44)], 4: [], 5: []}
    assert pii.redact(table(spark, [(1, texts[0])])).first()["text"] == 'token = "<secret>" then'


def test_many_spans(spark):
    """A text of very many matches costs about its length, and its places are right."""
    text = " ".join(f"é user{i}@mail.example 10.0.{i % 300}.7" for i in range(30_000))
    began = time.monotonic()
    found = pii.find_pii(table(spark, [(1, text)])).first()["found"]
    want = [(m.start(), kind) for kind, p, ok in RULES[:2] for m in re.finditer(p, text) if ok(m.group())]
    assert [(x["start"], x["kind"]) for x in found] == sorted(want) and len(found) > 50_000
    clean = pii.redact(table(spark, [(1, text)])).first()["text"]
    assert clean.count("<email>") == 30_000 and clean.count("<ip>") == len(found) - 30_000 and "@" not in clean
    assert time.monotonic() - began < 60


def test_iban_before_capitals(spark):
    numbers = ["AT61 1904 3002 3457 3201", "ES91 2100 0418 4502 0005 1332", "BE68 5390 0754 7034", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947"]
    tails = [" BIC BKAUATWW", " SWIFT code", " EUR", " BE68 5390 0754 7034", "", ". AND MORE"]
    rows = [(i, f"pay to {n}{t}") for i, (n, t) in enumerate((n, t) for n in numbers for t in tails)]
    got = {r["doc_id"]: [x["text"] for x in r["found"] if x["kind"] == "iban"] for r in pii.find_pii(table(spark, rows)).collect()}
    assert all(got[i][0] == numbers[i // 6] and got[i][1:] == ([numbers[2]] if i % 6 == 3 else []) for i, _ in rows)
    # ZZ is no country of the table: mod-97 alone tells where it ends
    check = 98 - int("190430023457320135350" + "0") % 97
    odd = f"ZZ{check:02d} 1904 3002 3457 3201"
    clean = pii.redact(table(spark, [(1, f"account {odd} BIC X"), (2, f"to {numbers[0]} BIC")])).orderBy("doc_id").collect()
    assert [r["text"] for r in clean] == ["account <iban> BIC X", "to <iban> BIC"]


def test_language(spark):
    rng = random.Random(2)

    def prose(parts):
        return " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(30))

    rows = [(i, prose(("the", "ing", "wh", "er")) if i % 2 else prose(("eau", "oi", "que", "é")), "en" if i % 2 else "fr") for i in range(200)]
    docs = clashing(table(spark, [*rows, (300, None, "en"), (301, "123 !? 🙂", "fr"), (302, "que eau", None), (303, rows[0][1] * 2000, "fr"), (None, "the whing", None)]))
    model = langid.fit(docs.where(~langid.held_out()))
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert all(got[i]["lang_pred"] == lang and 0 <= got[i]["score"] <= 1 for i, _, lang in rows)
    assert [got[i]["lang_pred"] for i in (300, 301, 302, 303, None)] == ["und", "und", "fr", "fr", "en"]
    assert langid.keep_identified(docs).count() == 203
    empty = table(spark, [])
    assert langid.predict(empty, langid.fit(empty)).count() == 0
    assert langid.predict(docs, langid.fit(empty)).where("lang_pred <> 'und'").count() == 0
    split = {r["i"]: r["h"] for r in spark.range(50).selectExpr("id AS i").select("i", langid.held_out("i").alias("h")).collect()}
    assert split == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(50)}


def test_mixing(spark):
    good, poor = "plain words of prose here and there", "win!!! cash$$$ now!!! click###"
    docs = clashing(table(spark, [(i, (good if i % 3 else poor) + " w%d" % i) for i in range(300)] + [(900, None), (901, " "), (None, good)]))
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 300, 2)] + [(5, None), (None, 1)], "doc_id long, quality int")
    rated, names = mixing.mix(docs, mixing.label_domains(labels))
    rows = rated.collect()
    assert names == ["good", "poor"] and len(rows) == 303 and all(abs(sum(r["p"]) - 1) < 1e-9 and r["rate"] >= 0 for r in rows)
    total = {d: sum(r["n_tokens"] * r["p"][d] for r in rows) for d in (0, 1)}
    mixed = {d: sum(r["n_tokens"] * r["p"][d] * r["rate"] for r in rows) for d in (0, 1)}
    assert mixed[0] == pytest.approx(total[0], rel=1e-2) and mixed[1] == pytest.approx(total[1] / 2, rel=1e-2)
    by_weight, _ = mixing.mix(docs, mixing.label_domains(labels), {"good": 1, "poor": 3}, budget=4000.0)
    got = by_weight.collect()
    assert [sum(r["n_tokens"] * r["p"][d] * r["rate"] for r in got) for d in (0, 1)] == pytest.approx([1000, 3000], rel=1e-2)
    out = mixing.resample(docs, mixing.label_domains(labels))
    assert out.columns == docs.columns and out.where("text LIKE 'plain%'").count() == 201 and 20 < out.where("text LIKE 'win%'").count() < 80
    plain, names = mixing.mix(docs, mixing.label_domains(labels.where("false")))
    assert names == [] and plain.where("rate = 1.0 AND copies = 1").count() == 303
    assert mixing.mix(table(spark, []), mixing.label_domains(labels))[0].count() == 0


def mixed_corpus(spark):
    texts = ["plain words of prose here and there", "win!!! cash$$$ now!!! click###", "vile hateful insult slur scorn"]
    kind = [0 if i % 10 < 4 else 1 if i % 10 < 9 else 2 for i in range(1000)]  # half poor, a tenth toxic
    docs = table(spark, [(i, texts[k] + " w%d" % i) for i, k in enumerate(kind)])
    return docs, spark.createDataFrame([(i, int(k != 1), int(k == 2)) for i, k in enumerate(kind)], "doc_id long, quality int, toxic int")


def test_mixing_weights(spark, tmp_path):
    docs, labels = mixed_corpus(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = mixing.op4(spark, str(tmp_path)).collect()
    got = {x: sum(r["n_tokens"] * r["p_" + x] * r["rate"] for r in rows) for x in mixing.TARGETS}
    assert {x: n / sum(got.values()) for x, n in got.items()} == pytest.approx(mixing.TARGETS, abs=1e-3)
    labelled = mixing.label_domains(labels)
    assert {r["domain"]: r["count"] for r in labelled.groupBy("domain").count().collect()} == {"good": 400, "poor": 500, "toxic": 100}


def test_quotes(spark):
    messages = [(1, 0, "u", "Hello there.\n\nSecond paragraph"), (1, 1, "a", "> Hello   THERE.\nHi!"), (1, 2, "u", "new topic"),
                (1, 3, "a", "On Monday u wrote:\n>> second paragraph\n> older\nReply to it\n> new topic"), (2, 5, "u", "> new topic\nelsewhere"),
                (2, 6, "u", None), (None, 1, "u", "x"), (3, 0, "u", "> new topic"), (2, 6, "u", None)]
    df = spark.createDataFrame([(*m, 1) for m in messages], "conv_id long, turn long, role string, text string, h int")
    got = {(r["conv_id"], r["turn"]): r for r in quotes.link_quotes(df).collect()}
    assert quotes.link_quotes(df).count() == 9
    first = got[1, 1]
    assert (first["body"], first["n_quotes"], first["n_linked"], first["parent_turn"], first["depth"]) == ("Hi!", 1, 1, 0, 1)
    assert (got[1, 3]["body"], got[1, 3]["n_quotes"], got[1, 3]["n_linked"], got[1, 3]["parent_turn"]) == ("Reply to it", 3, 2, 2)
    assert (got[1, 3]["root_turn"], got[1, 3]["depth"]) == (0, 3)
    assert (got[2, 5]["parent_conv"], got[2, 5]["parent_turn"], got[2, 5]["depth"]) == (1, 2, 0)
    assert (got[2, 6]["body"], got[2, 6]["parent_turn"], got[3, 0]["body"], got[None, 1]["n_quotes"]) == ("", 5, "", 0)
    assert quotes.link_quotes(df.where("false")).count() == 0


def brute_quotes(messages):
    """(n_quotes, n_linked, parent, root, depth, position) of one row per turn, message by message."""
    def parse(text):
        lines = []
        for line in re.split(r"\r\n|\r|\n", text):
            marks = re.match(quotes.MARKS, line)
            lines.append((marks.group(1).count(">"), line[marks.end():]) if marks else (0, line))
        mark = [i + 1 < len(lines) and lines[i + 1][0] > v and bool(re.match(quotes.ATTRIBUTION, t)) for i, (v, t) in enumerate(lines)]
        body = "\n".join(t for (v, t), m in zip(lines, mark, strict=True) if v == 0 and not m).strip()
        runs, said = [], [x for x, m in zip(lines, mark, strict=True) if x[0] == 0 or not m]
        for i, (v, t) in enumerate(said):
            if v and i and said[i - 1][0] == v:
                runs[-1][1].append(t)
            elif v:
                runs.append((v, [t]))
        return body, [(v, "\n".join(t)) for v, t in runs]

    def cut(text):
        out = {}
        for grain, parts in enumerate(([text], re.split(r"\n[ \t]*\n", text), text.split("\n"))):
            for x in (" ".join(p.lower().split()) for p in parts):
                if x:
                    out.setdefault(x, grain)
        return out

    parsed = {m: parse(t) for m, t in messages.items()}
    has = defaultdict(list)
    for m in sorted(parsed):
        for x in cut(parsed[m][0]):
            has[x].append(m)
    got = {}
    for m in sorted(parsed):
        best, linked = None, 0
        for place, (level, text) in enumerate(parsed[m][1]):
            votes = defaultdict(int)
            for x, grain in cut(text).items():
                near = [o for o in has[x] if o[0] == m[0] and o[1] < m[1]]
                far = [o for o in has[x] if o[0] != m[0]]
                if near:
                    votes[grain, 0, near[-1]] += len(x)
                if far:
                    votes[grain, 1, far[0]] += len(x)
            if votes:
                linked += 1
                to = min(votes, key=lambda v: (v[0], v[1], -votes[v], 0 if v[1] == 0 else v[2][0], -v[2][1] if v[1] == 0 else v[2][1]))[2]
                best = min(best or (level, place, to), (level, place, to))
        before = [o for o in parsed if o[0] == m[0] and o[1] < m[1]]
        parent = best[2] if best else max(before) if before else None
        inside = parent is not None and parent[0] == m[0]
        got[m] = [len(parsed[m][1]), linked, parent, got[parent][3] if inside else m[1], got[parent][4] + 1 if inside else 0, 0]
    for c in {m[0] for m in got}:
        for i, m in enumerate(sorted((m for m in got if m[0] == c), key=lambda m: (got[m][3], got[m][4], m[1])), 1):
            got[m][5] = i
    return got


def test_quotes_brute(spark):
    """Invented mail with nested quotes, gaps in the turns, and a conversation that holds a third of all messages."""
    rng = random.Random(12)
    words = ["alpha", "beta", "gamma", "delta", "Epsilon", "zeta"]
    messages = {}
    for k in range(240):
        m = (0 if k % 3 == 0 else rng.randrange(1, 12), k * 2 + rng.randrange(2))
        earlier = [o for o in messages if o[0] == m[0] or rng.random() < 0.05]
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 3))]
        if earlier and rng.random() < 0.7:
            quoted = messages[rng.choice(earlier)].split("\n")
            a = rng.randrange(len(quoted))
            part = quoted[a:a + rng.randint(1, 4)]
            lines = ["On Monday someone wrote:"] * (rng.random() < 0.5) + [">" + " " * (not x.startswith(">")) + x for x in part] + lines
        if rng.random() < 0.3:
            lines.insert(len(lines) // 2, "")
        messages[m] = "\n".join(lines)
    df = spark.createDataFrame([(c, t, "u", x) for (c, t), x in messages.items()], "conv_id long, turn long, role string, text string").repartition(3)
    got = {(r["conv_id"], r["turn"]): [r["n_quotes"], r["n_linked"], (r["parent_conv"], r["parent_turn"]) if r["parent_conv"] is not None else None,
                                       r["root_turn"], r["depth"], r["position"]] for r in quotes.link_quotes(df).collect()}
    want = brute_quotes(messages)
    assert sum(r[1] for r in want.values()) > 60 and got == want


def test_quotes_grow_evenly(spark):
    """A passage that is said and quoted at every turn, and a message of very many passages."""
    n = 3000
    rows = [(1, 3 * i, "u", "> the same words\n\nthe same words\n") for i in range(n)] + [(2, 1, "u", "\n".join(f"> a{i}\nb{i}" for i in range(20_000)))]
    began = time.monotonic()
    got = {(r["conv_id"], r["turn"]): r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert all((r["parent_turn"], r["depth"], r["body"]) == (t - 3 if t else None, t // 3, "the same words") for (c, t), r in got.items() if c == 1)
    assert got[2, 1]["n_quotes"] == 20_000 and time.monotonic() - began < 90


def test_quotes_of_passages(spark):
    messages = [(1, 0, "u", "The original question"), (1, 1, "a", "Sounds good."), (1, 2, "u", "> Sounds good.\n> On Monday X wrote:\n>> the original question\nThen let us go"),
                (2, 0, "u", "First line\nsecond line\nthird line\n\nParagraph two\n\nParagraph three\n\nEnd"), (2, 1, "a", "Third line"),
                (2, 2, "a", "> second line\n> third line\nyes"), (2, 3, "u", "> Paragraph two\n>\n> Paragraph three\nwell"),
                (3, 0, "u", "> shared words\nnow"), (3, 1, "u", "shared words"), (4, 7, "u", "shared words"), (5, 0, "u", ">\nx"), (5, 1, "u", "a\n\nb")]
    df = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): (r["n_quotes"], r["n_linked"], r["parent_conv"], r["parent_turn"]) for r in quotes.link_quotes(df).collect()}
    assert got[1, 2] == (2, 2, 1, 1)  # not the grandparent
    assert got[2, 2] == (1, 1, 2, 0) and got[2, 3] == (1, 1, 2, 0)
    assert got[3, 0] == (1, 1, 4, 7)  # the first is a later turn of its own conversation
    assert got[5, 0][:2] == (1, 0)


def test_exact(spark):
    rows = [(1, "a b"), (2, "ab "), (3, "a\tb\n"), (4, None), (5, ""), (6, " "), (7, "ab "), (2, "ab "), (None, "zz"), (8, "zz")]
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(clashing(table(spark, rows))).collect()), key=str)
    assert got == sorted([(1, 3, 4, False), (2, 3, 4, False), (2, 3, 4, False), (3, 3, 4, True), (4, 6, 3, False), (5, 6, 3, False), (6, 6, 3, True), (7, 7, 1, True),
                          (8, 8, 2, True), (None, 8, 2, False)], key=str)
    index = exact_dedup.DigestIndex(spark)
    exact_dedup.exact_dedup(table(spark, rows[:3]), index=index).count()
    again = {r["doc_id"]: (r["keep_id"], r["kept"], r["seen_before"]) for r in exact_dedup.exact_dedup(table(spark, [(50, "AB"), (51, "a  b")]), index=index).collect()}
    assert again == {50: (50, True, False), 51: (3, False, True)} and index.read().count() == 2
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0
    kept = exact_dedup.unique_rows(clashing(table(spark, rows)))
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([3, 6, 7, 8], key=str) and "digest" in kept.columns


def test_exact_by_batches(spark):
    """A batch that runs twice gets the same answer; several batches keep the rows that one batch keeps."""
    def run(rows, index, name=None):
        out = exact_dedup.exact_dedup(table(spark, rows), index=index, batch=name)
        return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["seen_before"]) for r in out.collect()), key=str)

    rows = [(i, f"text {i % 7}") for i in range(30)] + [(None, "text 1"), (40, None)]
    first, second = rows[:18], rows[18:]
    index = exact_dedup.DigestIndex(spark, "digests_of_the_test", 3)
    one = run(first, index)
    assert run(first, index) == one and sum(r[3] for r in one) == 7
    two = run(second, index)
    assert run(second, index) == two and run(first, index) == one and [r[0] for r in two if r[3]] == [40]
    assert {r[0] for r in one + two if r[3]} == {r[0] for r in run(rows, exact_dedup.DigestIndex(spark)) if r[3]}
    assert index.read().count() == 8
    again = run(first, index, "delivered once more")
    assert not any(r[3] for r in again) and all(r[4] for r in again)
    # a digest half of whose append was lost: the retry adds the rest
    other = exact_dedup.DigestIndex(spark)
    groups = spark.createDataFrame([(b"x", 1, 1, "b")], exact_dedup.DigestIndex.COLUMNS)
    other.append(groups)
    other.append(groups.union(spark.createDataFrame([(b"y", 2, 1, "b")], exact_dedup.DigestIndex.COLUMNS)))
    assert sorted((bytes(r["digest"]), r["keep_id"]) for r in other.read().collect()) == [(b"x", 1), (b"y", 2)]
    long = "word " * 400_000
    assert run([(1, long), (2, long + " "), (3, long + "x")], exact_dedup.DigestIndex(spark)) == sorted([(1, 2, 2, False, False), (2, 2, 2, True, False), (3, 3, 1, True, False)], key=str)


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_carried(spark, parts):
    rng = random.Random(9)
    rows = sorted({(rng.choice([1, 1, 1, 2, 3, 7, 8]), rng.randrange(400)) for _ in range(500)})
    rows = [(k, t, t if rng.random() < 0.2 else None) for k, t in rows]
    want, state = {}, {}
    for k, t, v in rows:
        n, last = state.get(k, (0, None))
        want[k, t] = (n + 1, last)
        state[k] = (n + 1, v if v is not None else last)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = carried(Workspace(spark, "t"), spark.createDataFrame(rows, "k long, t long, v long"), ["k"], ["t"], "v", "rows").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r["k"], r["t"]): (r["__n"], r["__before"]) for r in out} == want


@needs_data
def test_exact_sql(spark):
    got = sorted(map(str, (tuple(r) for r in QUERIES["op6_exact_dedup"](spark, SMALL).collect())))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    assert got == sorted(map(str, db.execute(exact_dedup.ORACLE).fetchall()))


@pytest.mark.parametrize("name, dtype", [("byte_bpe_50k.json", "<u4"), ("word_bpe_49k.json", "<u2")])
def test_encoder(name, dtype):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("aé'sSt T\n\t .,!9½🙂<|x́") for _ in range(80)) for _ in range(300)]
    whole = [np.array(e.ids, dtype=dtype).tobytes() for e in Tokenizer.from_file(tokenizer_path(name)).encode_batch(texts, add_special_tokens=False)]
    for keep in (1000, 5):
        enc = Encoder(tokenizer_path(name), dtype, keep)
        assert enc.encode(texts) == whole and enc.encode(texts[::-1]) == whole[::-1] and len(enc.table) <= keep + 1


def long_docs():
    rng = random.Random(6)
    return [(i, " ".join(rng.choice(["alpha", "beta", "gamma,", "Delta"]) for _ in range(rng.choice([0, 3, 40, 300, 900, 5000])))) for i in range(60)] + [(90, None), (91, ""), (None, "x"), (5, "x")]


def test_packing(spark):
    rows = long_docs()
    got = packing.pack(clashing(table(spark, rows).repartition(3)), tokenizer_path("byte_bpe_50k.json")).collect()
    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4"))
    pieces, sequences, steps = defaultdict(list), defaultdict(list), defaultdict(set)
    for r in got:
        pieces[r["doc_id"], r["doc_tokens"]].append(r)
        sequences[r["sequence_id"]].append(r)
        steps[r["step_id"]].add(r["seq_len"])
    assert sum(len(v) for v in want.values()) == len(rows) and sum(r["length"] for r in got) == sum(len(a) for v in want.values() for a in v)
    for i, arrays in want.items():
        for a in arrays:
            at = 0
            for r in sorted((r for r in pieces[i, len(a)]), key=lambda r: r["start"]):
                assert r["start"] == at and r["ids_crc32"] == zlib.crc32(a[at:at + r["length"]].tobytes())
                at += r["length"]
            assert at == len(a)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and at & (at - 1) == 0 and at == parts[0]["seq_len"]
    assert all(len(s) == 1 for s in steps.values())
    tokens, lengths = defaultdict(int), defaultdict(set)
    for r in got:
        tokens[r["step_id"]] += r["length"]
        lengths[r["seq_len"]].add(r["step_id"])
    for size, ids in lengths.items():  # full steps, and for each length a last one that isn't
        short = [tokens[i] for i in ids if tokens[i] != packing.STEP_TOKENS]
        assert all(n < packing.STEP_TOKENS for n in short) and len(short) <= 1 and (size >= 256 or len({r["sequence_id"] for r in got if r["seq_len"] == size}) == 1)
    assert packing.pack(table(spark, []), tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_packing_rests(spark, monkeypatch):
    """Rests of many tasks fill sequences and steps together; a tier's last steps share its sequences evenly."""
    rows = [(i, "x " * (i * 37 % 300)) for i in range(400)]
    pieces = packing.pack(table(spark, rows).repartition(40), tokenizer_path("byte_bpe_50k.json"), step_tokens=4096).collect()
    total = sum({r["doc_id"]: r["doc_tokens"] for r in pieces}.values())
    assert sum(r["length"] for r in pieces) == total and len({(r["sequence_id"], r["offset"]) for r in pieces}) == len(pieces)
    size = {r["sequence_id"]: r["seq_len"] for r in pieces}
    assert sum(size.values()) == total and sum(n < 256 for n in size.values()) <= 8
    packer = packing.Packer(0, step_tokens=1000)
    for k in range(7):
        packer.open_steps.setdefault(256, []).append([(k, 0, 256, 0, 256, k, 0, 256, None)])
    packer.close()
    assert sorted(np.bincount([r[8] for r in packer.drain()]).tolist()) == [2, 2, 3]


def test_binary(spark):
    rows = long_docs()
    ws = Workspace(spark, "t")
    path = tokenizer_path("word_bpe_49k.json")
    manifest = binary_output.write_shards(clashing(table(spark, rows)), ws.path("shards"), path, seq_len=64).collect()
    got = [tuple(r) for r in binary_output.read_shards(spark, manifest, ws.path("shards")).orderBy("start").collect()]
    tok = Tokenizer.from_file(path)
    at, ids = 0, sorted((r[0] if r[0] is not None else -1 for r in rows))
    assert [r[0] if r[0] is not None else -1 for r in got] == ids
    left = defaultdict(list)
    for i, t in rows:
        left[i].append(np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4"))
    for doc_id, start, n, crc in got:
        match = [a for a in left[doc_id] if len(a) == n and zlib.crc32(a.tobytes()) == crc]
        assert start == at and match
        at += n
    name = manifest[0]["name"]
    batch = binary_output.Shard(ws.path("shards"), name)._batch(0)
    assert batch.schema.field("ids").type == pa.list_(pa.uint16(), 64) and batch.column(1).flatten()[0].as_py()
    empty = binary_output.write_shards(table(spark, []), ws.path("none"), path).collect()
    assert binary_output.read_shards(spark, empty, ws.path("none")).count() == 0


def test_sequence(spark, tmp_path):
    ids = np.arange(1, 1501, dtype="<u2")
    with pa.OSFile(f"{tmp_path}/s.arrow", "wb") as sink:
        out = binary_output.ShardWriter(sink, "<u2", 2)
        for part in np.split(ids, [3, 1400]):  # a batch of more than 512 sequences, and a last one
            out.add(part.tobytes())
        out.add(b"\7\0")
        out.close()
    shard, want = binary_output.Shard(str(tmp_path), "s"), np.append(ids, [7, 0])
    assert [len(x) for x in shard.batches()] == [1024, 477]  # equal batches, and a last one
    for k in (750, 0, 511, 512, 700, 701, 1):
        got, mask = shard.sequence(k)
        assert got.tolist() == want[2 * k:2 * k + 2].tolist() and mask.to_pylist() == [True, k < 750] and not got.flags.owndata
    for k in (751, 1024, 5000, -1):
        with pytest.raises(IndexError):
            shard.sequence(k)
    assert binary_output.Shard(str(tmp_path), "s").sequence(600)[0].tolist() == [1201, 1202]  # without reading those before


def test_shards_of_one_id(spark, monkeypatch):
    """Rows that share an id are split over shards, and shards grow in number with the characters."""
    monkeypatch.setattr(binary_output, "SHARD_CHARS", 500)
    ws, path = Workspace(spark, "t"), tokenizer_path("word_bpe_49k.json")
    docs = table(spark, [(None if i % 3 else 5, f"text of number {i}") for i in range(300)])
    manifest = binary_output.write_shards(docs, ws.path("shards"), path).collect()
    assert len(manifest) > 8 and max(r["n_docs"] for r in manifest) < 100
    assert binary_output.read_shards(spark, manifest, ws.path("shards")).count() == 300


def test_other_rules(tmp_path):
    """A vocabulary with rules that aren't known is encoded by the library alone."""
    stated = json.load(open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8"))
    stated["pre_tokenizer"]["add_prefix_space"] = True
    path = f"{tmp_path}/other.json"
    json.dump(stated, open(path, "w", encoding="utf-8"))
    enc, texts = Encoder(path, "<u4"), [*ODD, "word by word"]
    assert not enc.known and Encoder(tokenizer_path("byte_bpe_50k.json"), "<u4").known and Encoder(tokenizer_path("word_bpe_49k.json"), "<u2").known
    assert enc.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_quality(spark):
    rng = random.Random(8)

    def prose(junk):
        w = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40)]
        return " ".join(x.upper() + "!!" if junk else x for x in w)

    docs = clashing(table(spark, [(i, prose(i % 4 == 0)) for i in range(300)] + [(400, None), (401, ""), (None, "x")]))
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(300)] + [(7, None), (None, 0), (9, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert len(got) == 303 and all(0 <= s <= 1 for s in got.values())
    assert all((got[i] >= 0.5) == (i % 4 > 0) for i in range(300))
    none = quality.score(docs, quality.fit(docs, labels.where("false"))).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.score(table(spark, []), quality.fit(docs, labels)).count() == 0


@pytest.mark.parametrize("block", [1024, 7])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(0)
    base = rng.standard_normal((300, 16)).astype(np.float32)
    x = [*base, *(base[:60] + rng.standard_normal((60, 16)).astype(np.float32) * 0.12), *np.repeat(base[5:6], 40, 0) + rng.standard_normal((40, 16)).astype(np.float32) * 0.02, base[7], base[7] * 2]
    odd = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16, [], [1.0, 2.0]]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, v) for i, v in enumerate(odd)]
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], "vec_id long, embedding array<float>, label int, key int").repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect()}
    u = np.array(x, dtype=np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    uf = Union()
    for i in range(len(x)):
        uf.find(i)
        for j in np.flatnonzero(near[i]).tolist():
            uf.union(i, j)
    want = {i: (int(near[i].sum()), uf.find(i), uf.find(i) == i) for i in range(len(x))} | {1000 + i: (0, 1000 + i, True) for i in range(len(odd))}
    assert got == want
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0


def test_numbered(spark, tmp_path):
    """Rows of Parquet files get one number each whatever the splits, without a stored copy; others are stored."""
    from gridlore.llm import common

    docs = clashing(table(spark, [(i % 7, f"t{i}") for i in range(500)]).repartition(5))
    docs.write.parquet(f"{tmp_path}/d")
    read = spark.read.parquet(f"{tmp_path}/d")
    ws = Workspace(spark, "t")
    once = {r["__row"]: r["text"] for r in common.numbered(ws, read.where("doc_id < 6")).collect()}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2000)
    try:
        again = common.numbered(ws, spark.read.parquet(f"{tmp_path}/d").where("doc_id < 6"))
        assert {r["__row"]: r["text"] for r in again.collect()} == once and len(once) == sum(i % 7 < 6 for i in range(500))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert common._one_parquet_scan(read.select("doc_id", "text")) and not any(map(common._one_parquet_scan, (docs, read.union(read), read.join(read, "doc_id"))))
    assert common.numbered(ws, read.union(read)).select("__row").distinct().count() == 1000
    assert common.numbered(ws, read).columns == [*read.columns, "__row"]


@pytest.mark.parametrize("stage", ["exact_dedup", "ngram_jaccard_join"])
def test_stages_decide_by_row(spark, stage):
    same, other, third = "one two three four five six seven", "quite different words stand in here now", "a third text that nothing else resembles at all"
    rows = [(None, same), (None, same), (4, same), (4, same), (2, same), (3, other), (4, third), (None, "alone with a null id and text"), (None, None)]
    docs = clashing(table(spark, rows).repartition(3))
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(map(str, (tuple(r)[:2] for r in out.collect()))) == sorted(map(str, [(2, same), *rows[5:]]))


@pytest.mark.parametrize("targets, budget", [({"good": 2, "poor": 1}, 600.0), ({"good": 2, "poor": 1}, 3000.0), ({"good": 19, "poor": 1}, 3900.0),
                                             ({"good": 0.95, "poor": 0.04, "toxic": 0.01}, None)])
def test_copies_reach_the_totals(spark, targets, budget):
    """Token totals of the copies meet the weights, whatever the size of the rates' fractions."""
    docs, labels = mixed_corpus(spark)
    rated, names = mixing.mix(docs, mixing.label_domains(labels), targets, budget=budget, weights=True)
    rows = rated.collect()
    got = {x: sum(r["n_tokens"] * r["p"][names.index(x)] * r["copies"] for r in rows) for x in targets}
    by_rate = {x: sum(r["n_tokens"] * r["p"][names.index(x)] * r["rate"] for r in rows) for x in targets}
    total = sum(targets.values())
    assert sum(got.values()) == pytest.approx(budget or sum(by_rate.values()), rel=0.01)
    assert {x: n / sum(got.values()) for x, n in got.items()} == pytest.approx({x: w / total for x, w in targets.items()}, abs=0.005)
    assert all(int(r["rate"] - 1e-6) <= r["copies"] <= int(r["rate"] + 1 + 1e-6) for r in rows)


def test_rates_brute(spark):
    """The rates are the nearest to 1 that meet the totals: numpy's projected gradient finds no nearer ones."""
    rng = np.random.default_rng(3)
    n = 400
    p = rng.dirichlet([0.4, 0.3, 0.2], n)
    t = rng.integers(1, 200, n).astype(float)
    goal_weights = np.array([0.6, 0.3, 0.1])
    soft = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(t, p, strict=True)], "n_tokens long, p array<double>")
    budget = 0.8 * t.sum()
    rate, report = mixing.fit_rates(soft, ["a", "b", "c"], {"a": 0.6, "b": 0.3, "c": 0.1}, budget, weights=True)
    got = {(r["n_tokens"], tuple(r["p"])): r["r"] for r in soft.select("n_tokens", "p", rate.alias("r")).collect()}
    r = np.array([got[int(a), tuple(b)] for a, b in zip(t, p, strict=True)])
    goal = goal_weights * budget
    assert (r >= 0).all() and np.allclose((t * r) @ p, goal, rtol=1e-3)
    # minimise sum t (x - 1)^2 with the totals as a heavy penalty, from elsewhere
    x, lam = np.full(n, 0.5), np.zeros(3)
    scale = (t[:, None] * p ** 2).sum(0)
    for _ in range(20_000):
        x = np.maximum(0, 1 - p @ lam)
        lam += 0.5 * ((t * x) @ p - goal) / scale.sum()
    assert np.allclose(r, x, atol=2e-2)


def test_resample_decides_by_row(spark):
    docs, labels = mixed_corpus(spark)
    from pyspark.sql import functions as F

    nulls = docs.unionByName(docs.withColumn("doc_id", F.lit(None).cast("long")))
    out = mixing.resample(nulls, mixing.label_domains(labels), mixing.TARGETS, weights=True)
    assert out.columns == docs.columns
    left = {r["n"]: r["count"] for r in out.where("text LIKE 'win%'").groupBy(F.col("doc_id").isNull().alias("n")).count().collect()}
    assert left.get(True, 0) < 150  # of 500


@needs_data
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count()
        docs = out
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard_join", "mixing", "packing"]


def test_lean_passes_all_batches_and_errors():
    def double(batches):
        for b in batches:
            if b == 9:
                raise ValueError("nine")
            yield 2 * b

    assert list(lean(double)([1, 2, 3])) == [2, 4, 6] and list(lean(double)([])) == []
    with pytest.raises(ValueError, match="nine"):
        list(lean(double)([1, 9]))
