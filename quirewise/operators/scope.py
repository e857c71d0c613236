"""Which editions a query looks at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirewise.session import stage, unstage
from quirewise.sources.model import Corpus

CANONICAL, ALL = "canonical", "all"


def check_scope(work: str | None = None, edition: str | None = None, editions: str | None = None) -> str | None:
    """The edition filter (None: canonical, 'all', or a year) of valid arguments; else ValueError."""
    if editions is not None and editions not in (CANONICAL, ALL):
        raise ValueError(f"editions must be {CANONICAL} or {ALL}, not {editions!r}")
    if edition is not None and editions is not None:
        raise ValueError("edition and editions exclude each other")
    if edition is not None and work is None:
        raise ValueError("edition needs a work")
    return edition if edition is not None else ALL if editions == ALL else None


def flagged(editions: DataFrame, wanted: str | None) -> DataFrame:
    """Editions that pass the edition filter by their own flags."""
    if wanted is None:
        return editions.filter("canonical")
    return editions if wanted == ALL else editions.filter(F.col("edition") == wanted)


def in_scope(editions: DataFrame, members: DataFrame, author: str | None = None, work: str | None = None, wanted: str | None = None, closed: bool = False) -> DataFrame:
    """Editions in scope. With a work: its editions that pass, and whatever is spliced into them (members: edition_id,
    member_id, direct, whose chains are followed here, or closed: followed already) regardless of flags. The author filter
    comes last and holds for borrowed editions too."""
    base = flagged(editions, wanted)
    if work is not None:
        base = base.filter(F.col("work") == work)
        reached = members if closed else closure(members)
        ids = base.select("edition_id").unionByName(base.join(reached, "edition_id").select(F.col("member_id").alias("edition_id")))
        base = editions.join(ids.distinct(), "edition_id", "left_semi")
    return base.filter(F.array_contains("authors", author)) if author is not None else base


def scoped(corpus: Corpus, author: str | None = None, work: str | None = None, wanted: str | None = None) -> DataFrame:
    """in_scope() of a corpus, by its compiled closure if there is one."""
    closed = corpus.borrowed is not None
    return in_scope(corpus.editions, corpus.borrowed if closed else corpus.members, author, work, wanted, closed)


def scope_name(edition: str | None = None, editions: str | None = None) -> str:
    """What an answer says about the printings it looked at: 'all' or 'canonical'."""
    return ALL if editions == ALL else CANONICAL


def closure(members: DataFrame) -> DataFrame:
    """edition_id, member_id: the transitive closure of direct borrowing, however long its chains. Each round joins the
    pairs found with themselves, until none is new."""
    found = stage(members.select("edition_id", "member_id").distinct(), "closure")
    size, before = found.count(), 0
    while size > before:
        on = found.select(F.col("edition_id").alias("member_id"), F.col("member_id").alias("next"))
        further = found.join(on, "member_id").select("edition_id", F.col("next").alias("member_id"))
        last, found = found, stage(found.unionByName(further).distinct(), "closure")
        unstage(last)
        size, before = found.count(), size
    return found
