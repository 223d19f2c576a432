"""Which of similar articles stay, first come first kept."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.session import settle, stored

#: Fixed value: titles are alike from this ratio on.
RATIO = 0.5


def _alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pairs in batches:
        found = [w or SequenceMatcher(None, b, a).ratio() > RATIO for a, b, w in zip(pairs["a"], pairs["b"], pairs["within"], strict=True)]
        yield pairs.loc[found, ["older", "newer"]]


def similar_titles(candidates: DataFrame) -> DataFrame:
    """(older, newer) of candidates (older, newer, a, b, within) one of whose titles holds the other, or whose ratio of matching characters is above ``RATIO``."""
    return candidates.mapInPandas(_alike, "older long, newer long")


def components(links: DataFrame) -> DataFrame:
    """(id, label) of all that links (older, newer) join: the least id of each component. Labels spread along links and jump along labels, so rounds grow with the logarithm of a chain."""
    both = stored(links.select(F.col("older").alias("id"), F.col("newer").alias("near")).unionByName(links.select(F.col("newer").alias("id"), F.col("older").alias("near"))).distinct())
    labels = stored(both.groupBy("id").agg(F.least(F.min("near"), F.col("id")).alias("label")))
    while True:
        seen = both.join(labels.withColumnsRenamed({"id": "near"}), "near").groupBy("id").agg(F.min("label").alias("seen"))
        spread = labels.join(seen, "id").select("id", "label", F.least("label", "seen").alias("next"))
        jumped = spread.join(labels.select(F.col("id").alias("next"), F.col("label").alias("far")), "next").select("id", "label", F.least("next", "far").alias("next"))
        jumped = stored(jumped)
        labels = jumped.select("id", F.col("next").alias("label"))
        if jumped.where("label != next").isEmpty():
            return labels


def _in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, gone) of the newer articles of a range of links (older, newer, first), by newer, as far as the range tells: ``first`` is an older one that no link leads to; what became of other ones from before the range is not known here."""
    fate: dict[int, bool | None] = {}
    now, gone = None, False
    ids: list[int] = []

    def told() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([fate[i] for i in ids], pa.bool_())], ["id", "gone"])
        ids.clear()
        return out

    def end() -> None:
        if now is not None:
            fate[now] = gone
            if gone is not None:
                ids.append(now)

    for batch in batches:
        for older, newer, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if newer != now:
                end()
                now, gone = newer, False
            one = False if first else fate.get(older)
            if one is False:  # it stays
                gone = True
            elif one is None and not gone:
                gone = None
        if len(ids) >= 10_000:
            yield told()
    end()
    yield told()


def dropped(links: DataFrame, rounds: int = 3, most: int = 1_000_000) -> DataFrame:
    """(id) of all that go: an article stays unless an older one that stays has a link (older, newer) to it.

    Each round settles the articles that no undecided older one has a link to, and
    drops those they link to; links of dropped ones then count no more. A few rounds
    leave the long chains: links are then dealt into ranges of newer articles, about
    ``most`` links each, and a task goes through a range in order and settles all that
    does not hang on an undecided article of an earlier range; it holds the fate of the
    range's articles, not the links. That is repeated until none is left; the first
    range is settled each time, and ranges get fewer.
    """
    links = settle(links.distinct())
    gone: list[DataFrame] = []

    def add(now: DataFrame) -> DataFrame:
        gone.append(now)
        if len(gone) > 8:
            whole = gone[0]
            for g in gone[1:]:
                whole = whole.unionByName(g)
            gone[:] = [settle(whole.coalesce(8))]
        return now

    without = lambda links, newer, older: links.join(newer, F.col("newer") == F.col("id"), "left_anti").join(older, F.col("older") == F.col("id"), "left_anti")
    done = 0
    while done < rounds and not links.isEmpty():
        first = links.select("older").distinct().join(links.select(F.col("newer").alias("older")).distinct(), "older", "left_anti")
        now = add(settle(links.join(first, "older", "left_semi").select(F.col("newer").alias("id")).distinct()))
        links = settle(without(links, now, now))
        done += 1
    while n := links.count():
        hangs = links.select(F.col("newer").alias("older"), F.lit(False).alias("first")).distinct()
        told = links.join(hangs, "older", "left").select("older", "newer", F.coalesce("first", F.lit(True)).alias("first"))
        dealt = told.coalesce(1) if n <= most else told.repartitionByRange(-(-n // max(most, 1)), "newer")
        found = settle(dealt.sortWithinPartitions("newer").mapInArrow(_in_turn, "id long, gone boolean"))
        add(found.where("gone").select("id"))
        links = settle(without(links, found.select("id"), found.where("gone").select("id")))
    whole = links.select(F.col("newer").alias("id")).limit(0)
    for g in gone:
        whole = whole.unionByName(g)
    return whole


def long_lane(classes: DataFrame, links: DataFrame, terms: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """(id, class_id, kept) of ``classes`` (id, class_id): ``links`` decide first, then ``terms`` among those left, then ``vectors`` (pairs of copies) among the rest; of a class its first article may stay.

    Links name classes by their first articles; articles that are in no class have no row.
    """
    member = classes.select("id", "class_id")
    name = lambda side: member.select(F.col("id").alias(side), F.col("class_id").alias(f"{side}_class"))
    named = links.join(name("older"), "older").join(name("newer"), "newer").select(F.col("older_class").alias("older"), F.col("newer_class").alias("newer"))
    gone = settle(dropped(named.where("older < newer")))
    kept = settle(member.where("id = class_id").join(gone, "id", "left_anti").select("id"))
    left = lambda side: kept.select(F.col("id").alias(side))
    late = dropped(terms.join(left("older"), "older").join(left("newer"), "newer"))
    stay = kept.join(late, "id", "left_anti").select("id")
    if vectors is not None:
        stay = settle(stay)
        side = lambda name: stay.select(F.col("id").alias(name))
        stay = stay.join(dropped(vectors.join(side("older"), "older").join(side("newer"), "newer").select("older", "newer")), "id", "left_anti")
    stays = stay.select("id", F.lit(True).alias("stays"))
    return member.join(stays, "id", "left").select("id", "class_id", F.coalesce("stays", F.lit(False)).alias("kept"))


def short_lane(articles: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, kept, related_to) of ``articles`` (id) by ``pairs`` (older, newer, action)."""
    pairs = settle(pairs.select("older", "newer", "action"))
    gone = settle(dropped(pairs.where("action = 'drop'").select("older", "newer")))
    out = gone.select("id", F.lit(False).alias("kept"))
    found = pairs.where("action = 'link'").join(gone, F.col("older") == F.col("id"), "left_anti").groupBy(F.col("newer").alias("id")).agg(F.min("older").alias("related"))
    every = articles.select("id").join(out, "id", "left").join(found, "id", "left")
    kept = F.coalesce("kept", F.lit(True))
    return every.select("id", kept.alias("kept"), F.when(kept, F.col("related")).alias("related_to"))
