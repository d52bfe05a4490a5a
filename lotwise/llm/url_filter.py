"""URL filters: rules first, then naive Bayes over the words of host and path.

Host labels and path parts are often words written together ("freecasinobonus"). A unigram Viterbi search splits them into the most
probable words; a multinomial naive Bayes model scores the words. Word counts come from all addresses, the text of all pages and a seed list; class counts from addresses
that hold a seed word of the blocked kind as a word of the split, and addresses that do not. Both classes are taken for about equally likely beforehand.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm import common as C

BLOCKED = "ads adserver adult bet betting bingo cam cams casino cheat crack escort fetish gambling hack hentai jackpot keygen lottery malware nude payday phishing pills poker porn replica scam sex slots spam torrent tracker viagra warez webcam xxx".split()
ORDINARY = (
    "about academy ad air all api app archive art author auto baby bank best big bike bio blog blue board bonus book box brand build buy cafe car care cash center chat city clean click cloud club code "
    "coffee college com community cook cool craft data date day deal dental design dev digital direct docs dog drive easy edu energy event example expert fan farm fast film finance fire fit food forum free fresh "
    "fun game garden gift girl go gold good green group guide hair health help home host hot hotel house info job kids lab land law learn life light link live local love mail market media "
    "mobile money music my net new news night now office online open org page park party pay people pet phone photo plan play plus post power press pro shop school science search shoes site smart social soft "
    "solar sport star stock store story street studio style tech top toy trade travel tube tv video vip water web wiki win wine world www zone tips "
    "ac edu gov museum"
).split()
_BLOCKED = frozenset(BLOCKED)
ENDINGS = ("s", "es", "ing", "er", "ers")
#: Letters from which a seed word counts beside letters that are no word.
LONG_SEED = 6
#: Letters of the longest word that split_words knows, and of the longest name whose split is remembered.
LONGEST, REMEMBERED = 40, 64
#: Log odds that speak for blocking must exceed this: where words say next to nothing, a url is allowed.
MARGIN = 0.5
#: Words' worth of evidence that smoothing adds to each class.
SMOOTHING = 10.0
#: Runs of letters of any script, and runs of digits.
_PART = re.compile(r"[^\W\d_]+|\d+")


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2] if "/" in self.text else ""


RULES = (Rule("allow", "org/"), Rule("block", "example.org/es/"), Rule("block", "example.org/en/1"), Rule("allow", "com/fr/"), Rule("block", "com/de/"))


@dataclass(frozen=True)
class UrlModel:
    words: dict[str, float]
    weights: dict[str, float]
    bias: float


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return C.ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Text of the longest rule that fits, or null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(rule.text)).otherwise(found)
    return found


def split_words(name: str, words: dict[str, float], longest: int = LONGEST) -> list[str]:
    """The most probable division of a run of letters into words; an unknown word costs more with every letter."""
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(name)
    for end in range(1, len(name) + 1):
        for start in range(max(0, end - longest), end):
            word = name[start:end]
            score = best[start][0] + words.get(word, -11.0 - 2.5 * len(word))
            if score > best[end][0]:
                best[end] = (score, start)
    out, end = [], len(name)
    while end:
        start = best[end][1]
        out.append(name[start:end])
        end = start
    return out[::-1]


def url_words(host: str, path: str, words: dict[str, float], split) -> list[str]:
    """Words of host and path; numbers become ``#``. Host words are told from path words. A run of letters that does not split into known words of three letters or more throughout is one word:
    what is left over beside a known word says that the split is wrong, unless that is a long seed word, which hardly stands in a name by chance."""
    out = []
    for kind, text in (("h", host), ("p", path.lower())):
        for part in _PART.findall(text):
            found = ["#"] if part[0].isdigit() else split(part)
            doubtful = len(found) > 1 and any(len(w) < 3 or w not in words for w in found)
            found = [part] if doubtful and not any(len(seed_of(w)) >= LONG_SEED for w in found) else found
            out += [f"{kind}:{w}" for w in found]
    return out


def splitter(words: dict[str, float]):
    """``split_words`` with a bounded memory of short names."""
    known = functools.lru_cache(maxsize=200_000)(lambda part: tuple(split_words(part, words)))
    return lambda part: known(part) if len(part) <= REMEMBERED else split_words(part, words)


def seed_of(word: str) -> str:
    """The seed word of the blocked kind that a word is, without a usual ending; "" for all others."""
    if word in _BLOCKED:
        return word
    return next((word[: -len(x)] for x in ENDINGS if word.endswith(x) and word[: -len(x)] in _BLOCKED), "")


def is_blocked(word: str) -> bool:
    """True for a seed word of the blocked kind and for one with a usual ending."""
    return seed_of(word) != ""


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n): the runs of letters in hosts and whole paths of all distinct addresses, and in the texts of the pages where they are given, that are no longer than the words of split_words."""
    host, path = url_parts(F.col("url"))
    texts = pages.select(host.alias("host"), F.lower(path).alias("path")).where("host <> ''").distinct().select(F.concat_ws("/", "host", "path").alias("text"))
    if "html" in pages.columns:
        texts = texts.unionByName(pages.select(F.lower(F.regexp_replace("html", r"(?s)<script.*?</script>|<[^>]*>", " ")).alias("text")))
    found = texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    return found.where(F.length("word").between(2, LONGEST)).groupBy("word").agg(F.count("*").alias("n"))


def train(pages: DataFrame, most: int = 20_000, vocabulary: int = 300_000) -> UrlModel:
    """Word counts from all addresses and texts, of which the ``vocabulary`` most frequent words seen twice are kept; class counts from at most ``most`` distinct addresses, those
    with the least hash."""
    host, path = url_parts(F.col("url"))
    pairs = pages.select(host.alias("host"), path.alias("path")).where("host <> ''").distinct()
    rows = sorted((r["host"], r["path"]) for r in pairs.orderBy(F.xxhash64("host", "path"), "host", "path").limit(most).collect())
    counts = Counter(dict.fromkeys(ORDINARY, 50) | dict.fromkeys(BLOCKED, 50))
    total = sum(counts.values())
    if rows:
        found = C.cut(word_counts(pages))
        total += found.agg(F.sum("n")).first()[0] or 0
        counts.update({x["word"]: x["n"] for x in found.where("n > 1").orderBy(F.col("n").desc(), "word").limit(vocabulary).collect()})
        C.drop(found)
    # seed words count as much as a frequent word of the corpus, so that names are split into them however large it is
    least = max(50, total // 20_000)
    counts.update({w: max(0, least - counts[w]) for w in (*ORDINARY, *BLOCKED)})
    words = {w: math.log(n / total) for w, n in counts.items()}
    split = splitter(words)
    seen = {True: Counter(), False: Counter()}
    for h, p in rows + [(f"{w}.example", "") for w in BLOCKED] + [(f"{w}.example", "") for w in ORDINARY]:
        got = url_words(h, p, words, split)
        bad = any(is_blocked(x.partition(":")[2]) for x in got)
        seen[bad].update(got)
    size = {c: sum(seen[c].values()) for c in seen}
    # smoothed towards the word's share in both classes together, so that a word that is rare or as frequent in both says nothing
    share = lambda x: SMOOTHING * (seen[True][x] + seen[False][x]) / (size[True] + size[False])
    chance = lambda x, c: math.log((seen[c][x] + share(x)) / (size[c] + SMOOTHING))
    odds = lambda x: chance(x, True) - chance(x, False)
    # a word that was seen a few times says little, unless it is a seed word; a seed word that was never seen says as much as the average one
    trust = lambda x: 1.0 if is_blocked(x.partition(":")[2]) else (n := seen[True][x] + seen[False][x]) / (n + 10)
    weights = {x: trust(x) * odds(x) for x in set(seen[True]) | set(seen[False])}
    return UrlModel(words, weights, -MARGIN)


def url_filter(pages: DataFrame, rules: tuple[Rule, ...] = RULES, model: UrlModel | None = None) -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule (the longest that fits, else null), verdict (the rule's, else by naive Bayes), score (log odds of block).

    A null url and one without ``://`` have an empty host and path, fit no rule and are allowed. Repeated rows give repeated results. A rule's path of "" fits every path; of equally
    long rules that fit (ties) the last in the order of their texts holds. Log odds of exactly 0 allow. Very long urls are split and scored whole. An empty table gives an empty result. Columns other than
    page_id, url and html are not looked at, whatever their names.
    """
    model = model or train(pages)
    host, path = url_parts(F.col("url"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(model.words)
        for batch in batches:
            odds = []
            for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist()):
                odds.append(model.bias + sum(model.weights.get(x, 0.0) for x in url_words(h, p, model.words, split)) if h or p else -math.inf)
            yield pa.record_batch([*batch.select(["page_id", "host", "path"]).columns, pa.array(odds, pa.float64())], ["page_id", "host", "path", "score"])

    kind = pages.schema["page_id"].dataType.simpleString()
    scored = pages.select("page_id", host.alias("host"), path.alias("path")).mapInArrow(score, f"page_id {kind}, host string, path string, score double")
    ruled = scored.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("score") > 0, "block").otherwise("allow")
    for rule in rules:
        own = F.when(F.col("rule") == rule.text, rule.verdict).otherwise(own)
    return ruled.select("page_id", "host", "path", "rule", own.alias("verdict"), "score")
