"""Phrases, the filter audit and line dedup against brute force."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.llm.collocations import PhraseParams, collocations
from lotwise.llm.filter_audit import filter_audit
from lotwise.llm.line_dedup import LineParams, bitmap, kept_text, line_dedup, run_lengths
from lotwise.llm.perfect_hash import PerfectHash

from .conftest import prose, table

BLANKS = " \t\n\x0b\x0c\r"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# -- 11 ----------------------------------------------------------------------------------------------------------------


def test_perfect_hash():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 50_000):
        keys = rng.integers(0, 2**64, n, dtype=np.uint64)
        table = PerfectHash(keys)
        assert sorted(table.find(keys)) == list(range(n)) and (table.keys[table.find(keys)] == keys).all()
        assert (table.find(rng.integers(0, 2**64, 1000, dtype=np.uint64)) == -1).all()


def mined(rows, min_count, percent, top):
    grams, words = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            ws = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(ws)
            for n in (1, 2, 3):
                for i in range(len(ws) - n + 1):
                    grams[lang, tuple(ws[i : i + n])] += 1
    found = {k: a for k, a in grams.items() if len(k[1]) > 1 and a >= min_count}
    out = collections.defaultdict(list)
    for (lang, p), a in found.items():
        if len(p) == 2 and any(found.get((lang, x), 0) * 100 >= percent * a for x in [q for (o, q) in found if o == lang and len(q) == 3 and p in (q[:2], q[1:])]):
            continue
        score, _, l, r = min((10**6 * a * a // (grams[lang, p[:k]] * grams[lang, p[k:]]), k, grams[lang, p[:k]], grams[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, words[lang], -s) for lang, some in out.items() for i, (s, a, p, l, r) in enumerate(sorted(some)[:top]))


def phrase_rows():
    rng = random.Random(11)
    few = ["ab", "Cd", "ef", "gh", "é", "ij", "x" * 3000]
    rows = [("en" if k % 3 else "de", " ".join(rng.choice(few) + rng.choice(["", "", "", ",", ".", "\n", "\t", "  ", "\xa0"]) for _ in range(60))) for k in range(60)]
    rows += [(None, "new york city " * 12 + "new york. city"), ("und", "New\tYork  city! " * 5), ("en", None), ("en", ""), ("fr", " ,.;"), ("", "one two three " * 11)]
    rows += [("en", "tie one tie two. " * 10)] * 2 + [("en", " ".join(prose(rng, 20_000).split()))]
    return rows


def test_phrases_equal_brute_force(spark):
    rows = phrase_rows()
    docs = spark.createDataFrame([(k % 7, t, x, "s", "w") for k, (x, t) in enumerate(rows)], "doc_id long, text string, lang string, key string, phrase string").repartition(5)
    for params in (PhraseParams(), PhraseParams(min_count=3, contained_percent=80, top=5), PhraseParams(min_count=2, block=300, filter_bits=16)):
        got = sorted(tuple(r) for r in collocations(docs, params).collect())
        assert got == mined(rows, params.min_count, params.contained_percent, params.top)
    assert collocations(docs.limit(0)).count() == 0


def test_many_partitions_are_summed_in_a_tree(spark):
    rows = [("en", "again and again. " * (1 + k % 3)) for k in range(120)]
    docs = spark.createDataFrame([(x, t) for x, t in rows], "lang string, text string").repartition(40)
    assert sorted(tuple(r) for r in collocations(docs).collect()) == mined(rows, 10, 50, 2000)


# -- 12 ----------------------------------------------------------------------------------------------------------------


def audited(rows, labels):
    """Every order run step by step."""
    key = lambda i: math.inf if i is None else i
    least = {}
    for i, t, _ in rows:
        least[t or ""] = min(least.get(t or "", math.inf), key(i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    docs = collections.defaultdict(list)
    for i, t, lang in rows:
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(ws) < 100, "B": 100 * len(set(ws)) < 80 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": key(i) > least[t]}
        docs[lang or ""].append(({f for f in fails if fails[f]}, i in good, i in toxic))
    out = {}
    for part, some in docs.items():
        by_filter = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = some
            for step, f in enumerate(order, 1):
                gone, left = [d for d in left if f in d[0]], [d for d in left if f not in d[0]]
                by_filter[f] += len(gone)
                redundant = sum(f in d[0] for d in some) - len(gone)
                out[part, order, step] = [len(left), len(gone), redundant, sum(d[0] == {f} for d in some), sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for p, order, step in out:
            if p == part:
                out[p, order, step].append(by_filter[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_equals_every_order_run(spark):
    rng = random.Random(4)
    rows = []
    for k in range(150):
        text = rng.choice([prose(rng, rng.choice([5, 99, 100, 180])), "Same WORDS again " * rng.choice([1, 40]), "LOUD " * 120, prose(rng, 150) + " #", rows[rng.randrange(len(rows))][1] if rows else ""])
        rows.append((k % 140, text, rng.choice(["en", "de", None, ""])))
    rows += [(None, rows[3][1], "en"), (None, "only here and without an id", "xx"), (None, "only here and without an id", "xx"), (900, None, "de"), (901, "", "en"), (902, prose(rng, 60_000), "en"), (903, "a" * 100_000, "de")]
    labels = [(k, k % 2, int(k % 5 == 0)) for k in range(0, 140, 2)] + [(3, 1, None), (3, 0, 1), (None, 1, 1), (5000, 1, 1), (902, 1, 1)]
    docs = spark.createDataFrame([(i, t, x, "c", "n", 7) for i, t, x in rows], "doc_id long, text string, lang string, part string, digest string, A int")
    marks = spark.createDataFrame([(*x, "e") for x in labels], "doc_id long, quality int, toxic int, id string")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in filter_audit(docs, marks).collect()}
    assert got == audited(rows, labels)
    assert filter_audit(docs.limit(0), marks).count() == 0
    assert filter_audit(docs, marks.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


# -- 13 ----------------------------------------------------------------------------------------------------------------


def test_bitmaps_round_trip(spark):
    rng = random.Random(8)
    cases = [(n, sorted(rng.sample(range(n), min(n, k)))) for n in (1, 2, 3, 50, 300, 40_000) for k in (0, 1, 2, n // 3, n)] + [(300, list(range(128, 256))), (300, list(range(128)))]
    df = spark.createDataFrame([(n, gone, "\n".join(map(str, range(n)))) for n, gone in cases], "n int, gone array<int>, text string").withColumn("keep", bitmap(F.col("gone"), F.col("n")))
    for r in df.withColumns({"runs": run_lengths(F.col("keep")), "left": kept_text(F.col("text"), F.col("keep"))}).collect():
        flags = [b for i, k in enumerate(r["runs"]) for b in [i % 2 == 0] * k]
        assert flags == [p not in set(r["gone"]) for p in range(r["n"])]
        assert r["left"] == "\n".join(str(p) for p in range(r["n"]) if flags[p])
        assert len(r["keep"]) <= 5 * (2 * len(r["gone"]) + 1)


def deduped(rows, min_docs, min_chars, keep):
    held, first = collections.defaultdict(set), {}
    at = lambda i, p: (i is None, i or 0, p)
    for i, t, _ in rows:
        for p, x in enumerate((t or "").split("\n")):
            k = lower(x).strip(BLANKS)
            if len(k) >= min_chars:
                held[k].add(i)
                first[k] = min(first.get(k, at(i, p)), at(i, p))
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        left = [x for p, x in enumerate(lines) for k in [lower(x).strip(BLANKS)] if len(held[k]) < min_docs or keep == "first" and at(i, p) == first[k]]
        out.append((repr(i), len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("params", [LineParams(), LineParams(min_docs=2, keep="first", slices=4), LineParams(min_docs=3, min_chars=12, slices=1)])
def test_lines_equal_brute_force(spark, odd, rows, none, params):
    rng = random.Random(2)
    more = [(200 + k, "\n".join([" Shared FOOTER\t", prose(rng, 4), "", "shared footer", "É " + str(k % 9), "\x0b"]), "a") for k in range(15)] + [(None, "shared footer\n\n", "a"), (None, "shared footer\nmore", "a"), (400, "\n" * 2000, "a"), (401, "x\n" * 3000 + "shared footer", "a")]
    whole = odd.unionByName(table(spark, more)) if params.min_docs != 3 else table(spark, rows + more)
    out = line_dedup(whole.withColumns({"h": F.lit("h"), "pos": F.lit("p"), "lines": F.lit("l"), "gone_at": F.lit("g")}), params)
    assert out.where("h = 'h' and pos = 'p' and lines = 'l' and gone_at = 'g' and id = 'z'").count() == len(rows) + len(more)
    got = out.select("doc_id", "n_lines", "n_dropped", F.sha2(kept_text(F.col("text"), F.col("keep")), 256))
    assert sorted((repr(r[0]), *r[1:]) for r in got.collect()) == deduped(rows + more, params.min_docs, params.min_chars, params.keep)
    assert line_dedup(none, params).count() == 0


def test_line_order_must_be_known(odd):
    with pytest.raises(ValueError):
        line_dedup(odd, LineParams(keep="last")).count()
