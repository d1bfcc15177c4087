"""URL filters: stated rules first, then association rules mined from labels.

A URL's tokens name its host, each of its parent domains, its path parts, extension, query keys,
fragment and scheme. Spark's FP-growth mines sets of tokens, with the label as one more token, on
labelled URLs; a set with at least ``SUPPORT`` bad URLs and ``CONFIDENCE`` bad ones among all that have
it becomes a block rule unless a smaller rule in it is about as sure; no other rule is left out. Two
things keep sets of tokens that say the same from being mined over and over. A host implies its parent
domains, so a set holds one of them: each URL gives a basket without any and one for each number of
host labels. Tokens that the same URLs have are mined as one; each of them gives a rule. Rules are
matched through an inverted index from token to rules: a rule fires when as many of its tokens are
found as it has. Stated rules (host and path prefix, longest first) decide before mined ones; what no
rule names is allowed.

Defined cases: a null URL, or one without ``://``, has an empty host and path, no rule and no tokens, and
is allowed; a line break in a token counts as ``%0A``; repeated rows are judged each; labelled URLs of
over ``LONGEST`` bytes teach nothing; without bad labels nothing is mined.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorspark.llm.runtime import cut

SAMPLE = 20000
SUPPORT = 20
CONFIDENCE = 0.6
LONGEST = 8192
STATED = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
_BAD = "label=bad"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_HOST_END, _PATH_END = re.compile(r"[/?#]"), re.compile(r"[?#]")


def split(url: str | None) -> tuple[str, str]:
    """Host and path of a URL."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    m = _HOST_END.search(rest)
    k = m.start() if m else len(rest)
    return rest[:k].translate(_LOWER), _PATH_END.split(rest[k:], maxsplit=1)[0]


def tokens(url: str | None) -> list[str]:
    """Distinct tokens of a URL; numbers, which name single pages, are left out."""
    host, path = split(url)
    if not host:
        return []
    labels = host.split(".")
    found = {f"host={'.'.join(labels[k:])}" for k in range(len(labels))}
    found |= {f"sub={labels[0]}"} if len(labels) > 2 else set()
    parts = [p for p in path.split("/") if p]
    found |= {f"path={p}" for p in parts if not p.partition(".")[0].isdigit()}
    if parts and "." in parts[-1]:
        found.add(f"ext={parts[-1].rsplit('.', 1)[1]}")
    if path.endswith("/"):
        found.add("end=/")
    query, _, fragment = url.partition("://")[2].partition("?")[2].partition("#")
    found |= {f"key={kv.partition('=')[0]}" for kv in query.split("&") if kv}
    fragment = fragment or url.partition("#")[2]
    if fragment:
        found.add("fragment")
    found.add(f"scheme={url.partition('://')[0].translate(_LOWER)}")
    return sorted(t.replace("\n", "%0A") for t in found)


@dataclass
class Rules:
    """Stated rules and mined token sets, with the index from each token to the sets that hold it."""

    stated: tuple[tuple[str, str], ...] = STATED
    mined: list[tuple[frozenset[str], float, int]] = field(default_factory=list)
    index: dict[str, list[int]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for k, (items, _, _) in enumerate(self.mined):
            for item in items:
                self.index.setdefault(item, []).append(k)
        self.longest = sorted(((*r.partition("/")[::2], r, v) for r, v in self.stated), key=lambda x: -len(x[2]))

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, int | None]:
        """Host, path, stated rule, verdict and the place of the mined rule that decided."""
        host, path = split(url)
        for h, p, rule, verdict in self.longest:
            if host and (host == h or host.endswith("." + h)) and path.startswith("/" + p):
                return host, path, rule, verdict, None
        hits = Counter(k for t in tokens(url) for k in self.index.get(t, ()))
        fired = min((k for k, n in hits.items() if n == len(self.mined[k][0])), default=None)
        return host, path, None, "allow" if fired is None else "block", fired


def _is_host(token: str) -> bool:
    return token.startswith("host=")


def baskets(rows: list[tuple[list[str], bool]]) -> tuple[list[list[str]], dict[tuple[int, str], list[str]]]:
    """Baskets of tagged items from (tokens, bad) rows, and the tokens that each item stands for.

    An item is ``level|token``; level 0 has no host token, level k the one of k labels. Its token is the
    first of those that the same rows of the level have, a host token before others.
    """
    levels: list[dict[int, list[str]]] = []
    posting: dict[tuple[int, str], list[int]] = {}
    for k, (found, _) in enumerate(rows):
        rest = [t for t in found if not _is_host(t)]
        own = {0: rest} | {t.count(".") + 1: [t, *rest] for t in found if _is_host(t)}
        levels.append(own)
        for level, items in own.items():
            for t in items:
                posting.setdefault((level, t), []).append(k)
    classes: dict[tuple[int, tuple[int, ...]], list[str]] = {}
    for (level, t), at in posting.items():
        classes.setdefault((level, tuple(at)), []).append(t)
    stands: dict[tuple[int, str], list[str]] = {}
    name: dict[tuple[int, str], str] = {}
    for (level, _), members in classes.items():
        first = min(members, key=lambda t: (not _is_host(t), t))
        stands[level, first] = [first] if _is_host(first) else sorted(members)
        name |= {(level, t): first for t in members}
    out = []
    for own, (_, bad) in zip(levels, rows, strict=True):
        for level, items in own.items():
            kinds = sorted({name[level, t] for t in items})
            if kinds:
                out.append([f"{level}|{t}" for t in kinds] + [f"{level}|{_BAD}"] * bad)
    return out, stands


def mine(labelled: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, sample: int = SAMPLE, longest: int = LONGEST) -> list[tuple[frozenset[str], float, int]]:
    """(tokens, confidence, bad URLs) rules from (url, bad) rows, best first.

    At most ``sample`` labelled URLs of at most ``longest`` bytes are used, the least by a hash, which
    bounds the one task that makes their baskets and the number of rules.
    """
    from pyspark.ml.fpm import FPGrowth

    rows = labelled.where("url IS NOT NULL AND bad IS NOT NULL").where(F.octet_length("url") <= longest).select("url", F.col("bad").cast("int").alias("bad"))
    rows = rows.orderBy(F.xxhash64("url", "bad"), "url", "bad").limit(sample).coalesce(1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(tokens(u), bool(b)) for batch in batches for u, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        found, stands = baskets(held)
        text = pa.list_(pa.string())
        for a in range(0, len(found), 5000):
            part = found[a : a + 5000]
            yield pa.RecordBatch.from_arrays([pa.array([None] * len(part), pa.string()), pa.array(part, text)], ["item", "items"])
        several = [(f"{level}|{t}", members) for (level, t), members in stands.items() if len(members) > 1]
        if several:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in several]), pa.array([m for _, m in several], text)], ["item", "items"])

    made = cut(rows.mapInArrow(scan, "item string, items array<string>"))
    ready = made.where("item IS NULL").select("items")
    n, bad = ready.agg(F.count("*"), F.count_if(F.exists("items", lambda x: x.endswith(f"|{_BAD}")))).first()
    if bad < support:
        return []
    sets = FPGrowth(minSupport=(support - 0.5) / n, minConfidence=1.0, itemsCol="items").fit(ready).freqItemsets
    level = F.substring_index(F.col("items")[0], "|", 1)
    plain = F.transform("items", lambda x: F.regexp_replace(x, "^[0-9]+[|]", ""))
    sets = sets.select(level.cast("int").alias("level"), plain.alias("items"), "freq")
    sets = sets.select("level", F.array_sort(F.array_remove("items", _BAD)).alias("items"), F.array_contains("items", _BAD).alias("bad"), "freq")
    sets = sets.where((F.size("items") > 0) & ((F.col("level") == 0) | F.exists("items", lambda x: x.startswith("host="))))
    rated = sets.groupBy("items").agg(F.max(F.when(F.col("bad"), F.col("freq"))).alias("bad"), F.max(F.when(~F.col("bad"), F.col("freq"))).alias("n"))
    rated = rated.where((F.col("bad") >= support) & (F.col("bad") >= confidence * F.col("n")))
    rated = cut(rated.select("items", F.array_join("items", "\n").alias("key"), (F.col("bad") / F.col("n")).alias("confidence"), "bad"))
    kept = _minimal(rated, rated.agg(F.max(F.size("items"))).first()[0] or 0)
    same = {r["item"]: r["items"] for r in made.where("item IS NOT NULL").collect()} if kept else {}
    out = {}
    for items, sure, count in kept:
        depth = next((t.count(".") + 1 for t in items if _is_host(t)), 0)
        for rule in itertools.product(*(same.get(f"{depth}|{t}", [t]) for t in items)):
            out[frozenset(rule)] = (sure, count)
    return sorted(((k, *v) for k, v in out.items()), key=lambda r: (-r[1], -r[2], sorted(r[0])))


def _minimal(rated: DataFrame, widest: int) -> list[tuple[frozenset[str], float, int]]:
    """Sets (items, key, confidence, bad) of which no kept smaller set is as sure but for 0.05, found size by size.

    Kept sets are looked up through an inverted index from their tokens, as in matching.
    """
    kept: list[tuple[frozenset[str], float, int]] = []
    for size in range(1, widest + 1):
        level = rated.where(F.size("items") == size)
        if kept:
            index = rated.sparkSession.createDataFrame([(t, k, len(items), sure) for k, (items, sure, _) in enumerate(kept) for t in items], "token string, rule int, size int, least double")
            met = level.select("key", "confidence", F.explode("items").alias("token")).join(index, "token").where("least >= confidence - 0.05")
            covered = met.groupBy("key", "rule", "size").agg(F.count("*").alias("n")).where("n = size")
            level = level.join(covered.select("key").distinct(), "key", "left_anti")
        kept += [(frozenset(r["items"]), float(r["confidence"]), int(r["bad"])) for r in level.select("items", "confidence", "bad").collect()]
    return kept


def judge_table(pages: DataFrame, rules: Rules, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, mined_rule) per row."""
    shared = pages.sparkSession.sparkContext.broadcast(rules)  # as many as SAMPLE URLs allow

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared.value.judge(u) for u in batch.column(1).to_pylist()]
            why = [None if g[4] is None else " ".join(sorted(shared.value.mined[g[4]][0])) for g in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([g[k] for g in got], pa.string()) for k in range(4)), pa.array(why, pa.string())], ["page_id", "host", "path", "rule", "verdict", "mined_rule"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"))
    return rows.mapInArrow(scan, "page_id long, host string, path string, rule string, verdict string, mined_rule string")


def labelled_urls(pages: DataFrame, labels: DataFrame, url_col: str = "url") -> DataFrame:
    """(url, bad) of pages whose path ends in the number of a labelled document.

    A page shows the document that its URL's number names; it is bad if that is of low quality or toxic.
    """
    number = F.regexp_extract(F.col(url_col), "^[^?#]*/([0-9]{1,18})(?:\\.html|/)?(?:[?#].*)?$", 1)
    marked = labels.groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    return pages.select(F.col(url_col).alias("url"), number.try_cast("long").alias("doc_id")).join(marked, "doc_id").select("url", "bad")
