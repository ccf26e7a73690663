"""URL filters: rules, then host word segmentation and multinomial naive Bayes."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_groups, materialise

#: (verdict, rule); a rule is a host and, from its first slash, a path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
SMOOTHING = 0.1
#: The name system's limits: no label of a host is longer than 63, no host than 253 characters.
LONGEST_LABEL, LONGEST_HOST = 63, 253
_PIECE = re.compile(r"[a-z]+|[0-9]+|[^\x00-\x7f]+")


def split_url(column: str = "url"):
    """Host and path columns: the host is what follows the first :// up to / ? # or the end, A-Z lower-cased; the path ends at ? # or the end."""
    url = F.coalesce(column, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({column}, instr({column}, '://') + 3)")).otherwise("")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, lower), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


class Rules:
    """Rules by host; judging a url looks up its host's suffixes, however many rules there are."""

    def __init__(self, rules: Sequence[tuple[str, str]]) -> None:
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host.lower(), []).append((slash + path, rule, verdict))

    def judge(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The longest fitting rule (of equally long ones that with the longer host) and its verdict."""
        best: tuple[int, int, str | None, str | None] = (-1, -1, None, None)
        labels = host.split(".")
        for i in range(len(labels)):
            suffix = ".".join(labels[i:])
            for prefix, rule, verdict in self.by_host.get(suffix, ()):
                if path.startswith(prefix):
                    best = max(best, (len(rule), len(suffix), rule, verdict))
        return best[2], best[3]


@dataclass
class Segmenter:
    """Unigram model of words; Viterbi finds the likeliest split of a concatenated name."""

    cost: dict[str, float]
    unknown: float

    @classmethod
    def fit(cls, counts: dict[str, int], total: int) -> Segmenter:
        total = max(total, 1)
        return cls({w: -math.log(c / total) for w, c in counts.items()}, math.log(total + 1) + 2.0)

    def split(self, name: str) -> list[str]:
        best, back = [0.0] + [math.inf] * len(name), [0] * (len(name) + 1)
        for end in range(1, len(name) + 1):
            for start in range(max(0, end - LONGEST_LABEL), end):
                word = name[start:end]
                c = self.cost.get(word)
                if c is None:
                    c = self.unknown + 2.5 * (end - start)
                if best[start] + c < best[end]:
                    best[end], back[end] = best[start] + c, start
        out, end = [], len(name)
        while end:
            out.append(name[back[end] : end])
            end = back[end]
        return out[::-1]


def tokens_of(host: str, path: str, segmenter: Segmenter, memo: dict[str, list[str]]) -> list[str]:
    """Host words (``h:``, the names of the host split into words), the top level name and path words; numbers by their length only."""
    out = []
    for kind, text in (("h:", host), ("p:", path.lower())):
        for piece in _PIECE.findall(text):
            if piece[0].isdigit():
                out.append(f"{kind}#{len(piece)}")
            elif kind == "h:":
                if piece not in memo:
                    if len(memo) > 200_000:
                        memo.clear()
                    memo[piece] = segmenter.split(piece)
                out += [kind + w for w in memo[piece]]
            else:
                out.append(kind + piece)
    return out


def path_tokens(path: str) -> list[str]:
    return tokens_of("", path, Segmenter({}, 0.0), {})


def log_odds(tokens: DataFrame, totals: tuple[int, int], types: int) -> DataFrame:
    """token, size, odds for every row of ``tokens`` (token, size, allow, block): log-odds of naive Bayes for block against allow.

    totals: tokens of allow and of block. SMOOTHING is added to the count of each of the ``types`` tokens.
    """
    allow, block = ((F.col(c) + SMOOTHING) / (n + SMOOTHING * types) for c, n in zip(("allow", "block"), totals, strict=True))
    return tokens.select("token", "size", F.log(block / allow).alias("odds"))


def count_words(pages: DataFrame) -> DataFrame:
    """word, n: counts of all words of all urls and html of all pages, names between separators; the table stays distributed."""
    texts = [F.expr(f"regexp_extract_all(lower(coalesce({c}, '')), '[a-z]+', 0)") for c in ("url", "html") if c in pages.columns]
    return pages.select(F.explode(F.concat(*texts)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def host_tokens(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """host, size, named for every row of ``hosts`` (host, size): the tokens of the host.

    The substrings of the hosts, from two letters to a label's longest, are looked up by a join in the counts of all words, so each host is
    split by the whole table. A host longer than the name system allows is not split: its runs of letters are its words.
    """
    counted = materialise(count_words(pages))
    total = counted.agg(F.sum("n")).first()[0] or 0
    unknown = Segmenter.fit({}, total).unknown

    def substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host in batch.column(0).to_pylist():
                found = {x[i:j] for x in re.findall("[a-z]+", host) for i in range(len(x)) for j in range(i + 2, min(len(x), i + LONGEST_LABEL) + 1)}
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([host] * len(found)), pa.array(sorted(found))], names=["host", "word"])

    def split(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for names, words in columns:
            out = []
            for host, known in zip(names.to_pylist(), words.to_pylist(), strict=True):
                segmenter = Segmenter({w["word"]: -math.log(w["n"] / total) for w in known or ()}, unknown)
                whole = {x: [x] for x in _PIECE.findall(host)} if len(host) > LONGEST_HOST else {}
                out.append(tokens_of(host, "", segmenter, whole))
            yield pa.array(out, pa.list_(pa.string()))

    pairs = hosts.select("host").filter(F.length("host") <= LONGEST_HOST).mapInArrow(substrings, "host string, word string")
    known = materialise(pairs.groupBy("word").agg(F.count("*").alias("size")).join(counted, "word"))
    pairs = materialise(join_groups(pairs, known, ["word"], "size").select("host", "word", "n"))
    found = pairs.groupBy("host").agg(F.collect_list(F.struct("word", "n")).alias("words"))
    return hosts.join(found, "host", "left").select("host", "size", F.arrow_udf(split, "array<string>")("host", "words").alias("named"))


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, learn_from: Column | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score for every row of ``pages``.

    A rule's verdict stands; other urls are judged by naive Bayes over the words of the segmented host and of the path. It learns from
    all urls that a rule decides, with all their tokens and the rule's verdict as the label; ``learn_from``, a condition on host and path,
    leaves some of them out to measure on. Without any, every url's score is 0.5 and it is allowed. A null url, or one without ://, has an
    empty host and path, fits no rule and is judged by the prior. Of equally long rules the one with the longer host decides. Repeated
    rows are judged alike; an empty table gives no rows; other columns, of whatever name, are not looked at.
    Tokens are counted as they are, in a distributed table; only the totals reach the driver.
    """
    spark = pages.sparkSession
    host, path = split_url()
    named = spark.sparkContext.broadcast(Rules(rules))

    def apply_rules(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for hosts, paths in columns:
            judged = [named.value.judge(h, p) for h, p in zip(hosts.to_pylist(), paths.to_pylist(), strict=True)]
            yield pa.array([{"rule": r, "verdict": v} for r, v in judged], pa.struct([("rule", pa.string()), ("verdict", pa.string())]))

    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    ruled = F.arrow_udf(apply_rules, "struct<rule:string,verdict:string>")
    urls = materialise(split.groupBy("host", "path").agg(F.count("*").alias("n")).withColumn("j", ruled("host", "path")))
    hosts = materialise(host_tokens(pages, urls.groupBy("host").agg(F.count("*").alias("size"))))
    label = F.when(F.lit(True) if learn_from is None else learn_from, F.col("j.verdict"))
    urls = materialise(join_groups(urls, hosts, ["host"], "size").select("host", "path", "n", "named", "j", label.alias("label"), F.monotonically_increasing_id().alias("url")))

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url, p, names, n, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if found := Counter(names + path_tokens(p)):
                    times, none = [n * k for k in found.values()], [0] * len(found)
                    columns = [[url] * len(found), list(found), list(found.values()), times if label == "allow" else none, times if label == "block" else none]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["url", "token", "times", "allow", "block"])

    words = materialise(urls.select("url", "path", "named", "n", "label").mapInArrow(words_of, "url bigint, token string, times bigint, allow bigint, block bigint"))
    counted = materialise(words.groupBy("token").agg(F.count("*").alias("size"), F.sum("allow").alias("allow"), F.sum("block").alias("block")))
    allow, block, types = counted.agg(F.coalesce(F.sum("allow"), F.lit(0)), F.coalesce(F.sum("block"), F.lit(0)), F.count("*")).first()
    odds = join_groups(words.select("url", "token", "times"), materialise(log_odds(counted, (allow, block), max(types, 1))), ["token"], "size").groupBy("url").agg(F.sum(F.col("times") * F.col("odds")).alias("odds"))
    seen = {r.label: r.n for r in urls.filter("label is not null").groupBy("label").agg(F.sum("n").alias("n")).collect()}
    prior = math.log((seen.get("block", 0) + 1) / (seen.get("allow", 0) + 1))

    log_ratio = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.lit(prior) + F.coalesce("odds", F.lit(0.0))))
    judged = urls.join(odds, "url", "left").select("host", "path", "n", "j", log_ratio.alias("odds"))
    verdict = F.coalesce("j.verdict", F.when(F.col("odds") > 0, "block").otherwise("allow"))
    judged = materialise(judged.select("host", "path", "n", "j.rule", verdict.alias("verdict"), (1 / (1 + F.exp(-F.col("odds")))).alias("block_score")))
    return join_groups(split, judged, ["host", "path"], "n").select("page_id", "host", "path", "rule", "verdict", "block_score")
