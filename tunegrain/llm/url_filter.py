"""URL verdicts: host rules first, then multinomial naive Bayes over the words of segmented hosts and path tokens.

Names of hosts are split into words by a unigram model (Viterbi): words from a fixed list and name parts that
several hosts of the table share. The classes of naive Bayes learn from the hosts themselves: a host with a word of
the fixed block list teaches ``block``, all others ``allow``; each host counts once, so a hot host weighs no more
than a small one. Tokens that go along with block words thereby count against hosts without them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tunegrain.llm.shared import materialize, split_by_membership


# Words that mark hosts to block, and common words of host names.
BLOCK_WORDS = (
    "spam casino adult porn xxx sex pills viagra pharma bets betting poker gambling slots jackpot ads adserver doubleclick track "
    "tracker tracking popup malware phishing warez crack keygen torrent escort dating loan payday bitcoin giveaway clickbait"
).split()
NAME_WORDS = (
    "www blog mail shop store news web site home page online free cheap win farm best top my the get go app dev docs wiki forum media "
    "cdn img static data cloud tech world daily times post press info book music video photo game games play sport travel food "
    "health bank pay market sale deal deals city school library example test net org com m en de fr es"
).split()
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Hosts that each word of the block list stands for besides the table's own. Their other tokens are those of ordinary
#: hosts, in proportion, so that these say nothing. UNSEEN is the count of a token that no allowed host has.
SEED_HOSTS = 10
UNSEEN = 0.01
#: Characters of the longest word that names are split into.
LONGEST = 24

#: The rules of the registered query.
RULES = (
    Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it's null or has no ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    whole = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(whole, pattern, 1), UPPER, LOWER)
    return host, F.regexp_extract(whole, pattern, 2)


def best_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits (its host or a subdomain, and the path's beginning); else null."""
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


@dataclass
class Model:
    """``words``: log probabilities for splitting names. ``weights``: log odds (block to allow) of tokens.

    Both hold the most frequent entries; ``rest_words`` (``token``, ``n``) and ``rest_tokens`` (``token``, ``b``, ``n``) are
    tables of all others, if there are any. What a row needs of them comes with it.
    """

    words: dict[str, float]
    total: float
    prior: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)
    allowed: int = 0
    of_allowed: float = 0.0
    of_blocked: float = 0.0
    rest_words: DataFrame | None = None
    rest_tokens: DataFrame | None = None

    def weight(self, b: int, a: int) -> float:
        """Log odds of a token that ``b`` blocked and ``a`` allowed hosts have."""
        return math.log((b + SEED_HOSTS * len(BLOCK_WORDS) * a / self.allowed) / self.of_blocked) - math.log(max(a, UNSEEN) / self.of_allowed)

    def split(self, name: str, more: dict[str, float] | None = None) -> list[str]:
        """The likeliest words of a name (``more``: further words); unknown runs cost more the longer they are."""
        best = [0.0] + [-math.inf] * len(name)
        back = [0] * (len(name) + 1)
        for end in range(1, len(name) + 1):
            for begin in range(max(0, end - LONGEST), end):
                part = name[begin:end]
                p = self.words.get(part)
                if p is None and more:
                    p = more.get(part)
                if p is None:
                    p = math.log(10.0 / self.total) - len(part) * math.log(10.0)
                if best[begin] + p > best[end]:
                    best[end], back[end] = best[begin] + p, begin
        out: list[str] = []
        at = len(name)
        while at:
            out.append(name[back[at] : at])
            at = back[at]
        return out[::-1]

    def host_tokens(self, host: str, more: dict[str, float] | None = None) -> list[str]:
        return [w for part in re.split(r"[.\-_:@]+", host) if part for w in self.split(part, more)]


def path_tokens(path: str) -> list[str]:
    """Words of a path, marked as such; digits count as a number, whatever it is."""
    return ["/" + re.sub(r"[0-9]+", "0", t.lower()) for t in re.split(r"[^0-9A-Za-z]+", path) if t]


def _words_of(model: Model, listed) -> dict[str, float]:
    """Log probabilities of the rest words that came with a host."""
    return {w["token"]: math.log(w["n"] / model.total) for w in listed or ()}


def _light(model: Model) -> Model:
    """The model without its tables, for tasks."""
    return replace(model, rest_words=None, rest_tokens=None)


def _examples(model: Model):
    model = _light(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = set(BLOCK_WORDS)
        kept: dict[str, list[str]] = {}
        for batch in batches:
            hosts, tokens, blocked = [], [], []
            for host, path, more in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if host not in kept:
                    if len(kept) > 50_000:
                        kept.clear()
                    kept[host] = model.host_tokens(host, _words_of(model, more))
                own = {*kept[host], *path_tokens(path)}
                hosts += [host] * len(own)
                tokens += sorted(own)
                blocked += [not block.isdisjoint(kept[host])] * len(own)
            yield pa.record_batch([pa.array(hosts, pa.string()), pa.array(tokens, pa.string()), pa.array(blocked, pa.bool_())], names=["host", "token", "blocked"])

    return run


def _candidates(model: Model, of_words: bool):
    """(host, path, token) of what may stand in a rest table: parts of a host's name (the path is empty), or tokens."""
    model = _light(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["host", "path", "token"]
        out: list[tuple[str, str, str]] = []
        for batch in batches:
            for host, path, more in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if of_words:
                    parts = set(re.split(r"[.\-_:@]+", host))
                    found = {p[i:j] for p in parts for i in range(len(p)) for j in range(i + 1, min(i + LONGEST, len(p)) + 1)} - model.words.keys()
                else:
                    found = {*model.host_tokens(host, _words_of(model, more)), *path_tokens(path)} - model.weights.keys()
                out += [(host, path, t) for t in found]
                if len(out) > 1 << 14:
                    yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=names)
                    out = []
        if out:
            yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=names)

    return run


_MORE_WORDS = "array<struct<token:string,n:bigint>>"
_MORE_TOKENS = "array<struct<token:string,b:bigint,n:bigint>>"


def _with_words(urls: DataFrame, model: Model) -> DataFrame:
    """``urls`` (its ``host`` and all else) with ``words``: the rest words that stand in the host."""
    if model.rest_words is None:
        return urls.withColumn("words", F.lit(None).cast(_MORE_WORDS))
    hosts = urls.where("host <> ''").select("host", F.lit("").alias("path"), F.lit(None).cast(_MORE_WORDS).alias("words")).distinct()
    parts = hosts.mapInArrow(_candidates(model, True), "host string, path string, token string")
    maybe, _ = split_by_membership(parts, model.rest_words.select("token"), "token")
    found = maybe.join(model.rest_words, "token").groupBy("host").agg(F.collect_list(F.struct("token", "n")).alias("words"))
    return urls.join(materialize(found, "url-host-words"), "host", "left")


def _with_tokens(urls: DataFrame, model: Model) -> DataFrame:
    """``urls`` (with ``words``) with ``more``: the rest tokens that stand in the url."""
    if model.rest_tokens is None:
        return urls.withColumn("more", F.lit(None).cast(_MORE_TOKENS))
    tokens = urls.select("host", "path", "words").dropDuplicates(["host", "path"]).mapInArrow(_candidates(model, False), "host string, path string, token string")
    maybe, _ = split_by_membership(tokens, model.rest_tokens.select("token"), "token")
    found = maybe.join(model.rest_tokens, "token").groupBy("host", "path").agg(F.collect_list(F.struct("token", "b", "n")).alias("more"))
    return urls.join(materialize(found, "url-rest"), ["host", "path"], "left")


def _most_frequent(counts: DataFrame, most: int) -> tuple[list[Row], DataFrame | None]:
    """The rows of the ``most`` frequent tokens, and all others, if any."""
    top = counts.orderBy(F.desc("n"), "token").limit(most + 1).collect()
    if len(top) <= most:
        return top, None
    edge = top[most]
    return top[:most], counts.where((F.col("n") < edge.n) | ((F.col("n") == edge.n) & (F.col("token") >= edge.token)))


def learn(urls: DataFrame, most_words: int = 20_000, most_tokens: int = 50_000) -> Model:
    """A model from all ``host`` and ``path`` rows; counts are over all hosts. The most frequent ``most_words`` words and
    ``most_tokens`` tokens are held in memory, all others in tables to join with; the verdicts don't depend on how many."""
    hosts = urls.where("host <> ''").select("host", "path").distinct()
    parts = hosts.select("host").distinct().select(F.explode(F.array_distinct(F.split("host", r"[.\-_:@]+"))).alias("part"))
    shared = parts.where("part <> ''").groupBy(F.col("part").alias("token")).agg(F.count("*").alias("n")).where("n >= 3")
    shared = materialize(shared, "url-words")
    of_all = shared.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("s"), F.count("*").alias("n")).first()
    # Words of the fixed lists are always in memory.
    fixed = sorted({*BLOCK_WORDS, *NAME_WORDS})
    top, rest = _most_frequent(shared.where(~F.col("token").isin(fixed)), most_words)
    counts = {r.token: float(r.n) for r in [*top, *shared.where(F.col("token").isin(fixed)).collect()]}
    base = max(3.0, of_all.s / max(1, of_all.n))
    for word in (*BLOCK_WORDS, *NAME_WORDS):
        counts[word] = counts.get(word, 0.0) + base
    total = of_all.s + base * (len(BLOCK_WORDS) + len(NAME_WORDS))
    model = Model({w: math.log(n / total) for w, n in counts.items()}, total, rest_words=rest)
    pairs = _with_words(hosts, model).select("host", "path", "words").mapInArrow(_examples(model), "host string, token string, blocked boolean")
    pairs = materialize(pairs.groupBy("host", "token").agg(F.max("blocked").alias("blocked")), "url-pairs")
    sizes = pairs.groupBy("host").agg(F.max("blocked").alias("blocked")).groupBy("blocked").agg(F.count("*").alias("n"))
    sizes = {r.blocked: r.n for r in sizes.collect()}
    allowed = sizes.get(False, 0)
    if not allowed:
        return model
    seen = pairs.groupBy("token").agg(F.sum(F.col("blocked").cast("bigint")).alias("b"), F.count("*").alias("n"))
    seen = materialize(seen, "url-tokens")
    sums = seen.agg(F.sum("b").alias("b"), F.sum("n").alias("n")).first()
    seeds = SEED_HOSTS * len(BLOCK_WORDS)
    model.allowed, model.of_allowed = allowed, sums.n - sums.b
    model.of_blocked = sums.b + seeds + seeds * model.of_allowed / allowed
    model.prior = math.log((sizes.get(True, 0) + 1) / (allowed + 1))
    # Words of the block list, which have counts of their own, are always in memory.
    top, model.rest_tokens = _most_frequent(seen.where(~F.col("token").isin(*BLOCK_WORDS)), most_tokens)
    counts = {w: (SEED_HOSTS, 0) for w in BLOCK_WORDS}
    for r in [*top, *seen.where(F.col("token").isin(*BLOCK_WORDS)).collect()]:
        counts[r.token] = (counts.get(r.token, (0, 0))[0] + r.b, r.n - r.b)
    model.weights = {t: model.weight(b, a) for t, (b, a) in counts.items()}
    return model


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "page_id", url_column: str = "url", most_words: int = 20_000, most_tokens: int = 50_000) -> DataFrame:
    """Per row the id, ``host``, ``path``, ``rule`` (the longest that fits, or null), ``verdict`` (allow or block) and ``odds``.

    Without a rule the verdict is naive Bayes': block if ``odds`` (log odds of block) is above 0. A null url, and one
    without ``://``, has an empty host and path and is judged by the prior. Ids may be null or repeat: each row
    is judged. An empty table gives an empty result. Other columns are ignored.
    """
    host, path = host_and_path(F.col(url_column).cast("string"))
    urls = pages.select(F.col(id_column).alias("page_id"), host.alias("host"), path.alias("path"))
    model = learn(urls, most_words, most_tokens)
    full = _with_tokens(_with_words(urls, model), model).select("page_id", "host", "path", "words", "more")
    light = _light(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list[str]] = {}
        for batch in batches:
            odds = []
            for host, path, words, more in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                if host not in kept:
                    if len(kept) > 50_000:
                        kept.clear()
                    kept[host] = light.host_tokens(host, _words_of(light, words))
                own = {t["token"]: light.weight(t["b"], t["n"] - t["b"]) for t in more or ()}
                of_host, of_path = (sum(light.weights.get(t, own.get(t, 0.0)) for t in tokens) for tokens in (kept[host], path_tokens(path)))
                odds.append(light.prior + of_host + of_path)
            yield pa.record_batch([*batch.columns[:3], pa.array(odds, pa.float64())], names=["page_id", "host", "path", "odds"])

    kind = urls.schema["page_id"].dataType.simpleString()
    scored = full.mapInArrow(run, f"page_id {kind}, host string, path string, odds double")
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("odds") > 0, "block").otherwise("allow")).alias("verdict"), "odds")
