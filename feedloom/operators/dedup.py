"""Suppression of repeated reads: one state machine for batch and stream.

Rows of one streamer come in order of (time, id). A row with both names is
 1. a repeat, if a kept row of equal (type, attacker, victim) is at most 20 s
    old: its reads count for the kept one;
 2. part of a chain, if its line resembles the first line of an open chain, or
    its victim a victim that the chain kept, and the chain was seen in the last
    150 s. A chain keeps its first rows and swallows the rest: two for rated
    types, eight for others, or four once it lasts three minutes;
 3. else the start of a new chain, which counts the kept rows of the last
    ``seed_us`` that resemble it as its own.
A rated row without any name is refused (its ``kept_id`` is null); other rows
without both names pass.

Rows of different types never meet (unless ``merge_types``), and a silence of
the rows of a type longer than all windows leaves no state, so stretches of
(streamer, type) between silences are folded on their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.similarity import Target, other_player_of_one_line, ratio_of

S = 1_000_000
#: So many independent stretches of a key share a task, for less overhead.
STRETCHES_A_TASK = 64


@dataclass(frozen=True)
class DedupRules:
    exact_us: int = 20 * S
    chain_gap_us: int = 150 * S
    line_similarity: float = 0.82
    victim_similarity: float = 0.85
    rated_types: tuple[str, ...] = ("Kill", "BleedOut")
    rated_cap: int = 2
    other_cap: int = 8
    long_chain_rows: int = 4
    long_chain_us: int = 180 * S
    merge_types: bool = False
    guard_victims: bool = False
    best_match: bool = False
    #: Look-back for kept rows that a new chain counts; 0: none.
    seed_us: int = 0
    seed_rows: int = 200
    #: Compare with the last line of a chain instead of the first, and lines as they are written.
    drifting: bool = False
    as_written: bool = False
    #: One cap for all types, whatever lasts how long.
    one_cap: int | None = None

    @property
    def reach_us(self) -> int:
        return max(self.chain_gap_us, self.exact_us, self.seed_us)


def norm(text: str | None) -> str:
    return "".join(ch for ch in (text or "").lower() if ch.isascii() and ch.isalnum())


@dataclass
class Chain:
    signature: str
    start: int
    last: int
    length: int
    kept_id: int
    victims: list[str] = field(default_factory=list)

    def resembles(self, signature: str, victim: str, rules: DedupRules) -> bool:
        """Whether the line resembles the chain's line, or the victim one that it kept and no other player of a like name."""
        if getattr(self, "_of", None) != self.signature:
            self._of, self._line = self.signature, Target(self.signature)
        if self._line.at_least(signature, rules.line_similarity):
            return True
        if not hasattr(self, "_names"):
            self._names = []
        while len(self._names) < len(self.victims):
            self._names.append(Target(self.victims[len(self._names)]))
        if not victim or not any(n.text and n.at_least(victim, rules.victim_similarity) for n in self._names):
            return False
        return not (rules.guard_victims and other_player_of_one_line(victim, self.victims))


@dataclass
class State:
    """What a streamer's past leaves behind; both parts are pruned by age."""

    exact: dict[tuple, tuple[int, int]] = field(default_factory=dict)
    chains: dict[str, list[Chain]] = field(default_factory=dict)
    #: Kept rows (us, id, type, line, victim) of the look-back, oldest first.
    kept: list[tuple] = field(default_factory=list)

    def dump(self) -> tuple:
        """Plain values, for a state store."""
        return list(self.exact.items()), [(k, [astuple(c) for c in v]) for k, v in self.chains.items()], self.kept

    @classmethod
    def load(cls, plain: tuple) -> State:
        return cls(dict(plain[0]), {k: [Chain(*c) for c in v] for k, v in plain[1]}, list(plain[2]))

    def prune(self, now: int, rules: DedupRules) -> None:
        self.exact = {k: v for k, v in self.exact.items() if now - v[0] <= rules.exact_us}
        self.chains = {k: live for k, c in self.chains.items() if (live := [x for x in c if now - x.last < rules.chain_gap_us])}
        if rules.seed_us:
            self.kept = [k for k in self.kept if now - k[0] <= rules.seed_us]


def step(state: State, us: int, id_: int, kind: str, attacker: str | None, victim: str | None, rules: DedupRules) -> int | None:
    """Id of the kept row that this row counts for: its own if it is kept, none if it is refused."""
    named = [bool(n and n.strip()) for n in (attacker, victim)]
    if not all(named):
        return None if kind in rules.rated_types and not any(named) else id_
    state.prune(us, rules)
    exact = (kind, attacker, victim)
    if exact in state.exact:
        return state.exact[exact][1]
    name = norm(victim)
    signature = f"{attacker}|{victim}".lower() if rules.as_written else norm(attacker) + "|" + name
    chains = state.chains.setdefault("" if rules.merge_types else kind, [])
    chain = _find(chains, signature, name, rules)
    if chain is None:
        earlier, last = _seed(state, kind, signature, name, rules)
        chain = Chain(signature, us, us, earlier + 1, id_ if last is None else last, [name])
        chains.append(chain)
        keep = last is None or not _over_cap(chain, kind, rules)
    else:
        chain.length += 1
        chain.last = us
        if rules.drifting:
            chain.signature = signature
        keep = not _over_cap(chain, kind, rules) or (
            rules.guard_victims and kind in rules.rated_types and other_player_of_one_line(name, chain.victims)
        )
    if not keep:
        return chain.kept_id
    chain.kept_id = id_
    if name and name not in chain.victims:
        chain.victims.append(name)
    state.exact[exact] = (us, id_)
    if rules.seed_us:
        state.kept.append((us, id_, kind, signature, name))
    return id_


def _seed(state: State, kind: str, signature: str, victim: str, rules: DedupRules) -> tuple[int, int | None]:
    """How many of the latest kept rows a new chain resembles, and the last of them."""
    if not rules.seed_us:
        return 0, None
    of_type = [k for k in reversed(state.kept) if rules.merge_types or k[2] == kind][: rules.seed_rows]
    line, hits, last, victims = Target(signature), 0, None, []
    who = Target(victim) if victim else None
    for _, id_, _, other, other_victim in of_type:
        like_victim = who is not None and bool(other_victim) and who.at_least(other_victim, rules.victim_similarity)
        if like_victim and victims and rules.guard_victims and other_player_of_one_line(victim, victims):
            like_victim = False
        if like_victim or line.at_least(other, rules.line_similarity):
            hits += 1
            last = id_ if last is None else last
            if other_victim and other_victim not in victims:
                victims.append(other_victim)
    return hits, last


def _find(chains: list[Chain], signature: str, victim: str, rules: DedupRules) -> Chain | None:
    best, best_at = None, 0.0
    for chain in chains:
        same = chain.resembles(signature, victim, rules)
        if same and not rules.best_match:
            return chain
        if same:
            r = ratio_of(signature, chain.signature)
            if r > best_at:
                best, best_at = chain, r
    return best


def _over_cap(chain: Chain, kind: str, rules: DedupRules) -> bool:
    if rules.one_cap is not None:
        return chain.length > rules.one_cap
    if kind in rules.rated_types:
        return chain.length > rules.rated_cap
    return chain.length > rules.other_cap or (chain.length > rules.long_chain_rows and chain.last - chain.start > rules.long_chain_us)


READS = "key string, id long, us long, event_type string, attacker string, victim string, reads long"
KEPT = READS + ", kept_id long"


def _stretches(rows: DataFrame, keys: list[str], gap_us: int) -> DataFrame:
    """``rows`` with ``stretch``: its number grows at every silence of the ``keys`` longer than ``gap_us``. Only gap-long cells are ordered."""
    celled = rows.withColumn("cell", F.floor(F.col("us") / gap_us))
    order = Window.partitionBy(*keys).orderBy("cell")
    cells = celled.groupBy(*keys, "cell").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    opens = F.when(F.col("first") - F.lag("last").over(order) <= gap_us, 0).otherwise(1)
    numbered = cells.withColumn("opens", opens).select(
        *keys, "cell", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("stretch")
    )
    return celled.join(numbered, [*keys, "cell"]).drop("cell")


def fold_sorted(rows: DataFrame, groups: list[str], order: list[str], fresh, step, out: str) -> DataFrame:
    """``rows`` folded in ``order`` group by group: ``step(state, row)`` gives a tuple of ``out`` (a schema), ``fresh()`` the state of a new group.

    Groups lie sorted in partitions and stream by, so many small ones cost no more than their rows and a large one needs no memory.
    """
    names = [c.split()[0] for c in out.split(", ")]
    columns = [*groups, *order, *(c for c in rows.columns if c not in groups and c not in order)]
    k = len(groups)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for pdf in batches:
            made = []
            for row in pdf.itertuples(index=False, name=None):
                if row[:k] != last:
                    last, state = row[:k], fresh()
                made.append(step(state, dict(zip(columns, row))))
            yield pd.DataFrame(made, columns=names, dtype=object)

    return rows.select(*columns).repartition(*groups).sortWithinPartitions(*groups, *order).mapInPandas(run, out)


def _text(x: object) -> str | None:
    return x if isinstance(x, str) else None


def dedup_events(reads: DataFrame, rules: DedupRules = DedupRules()) -> DataFrame:
    """``reads`` (READS) with the id of the kept row that each counts for, null if it is refused. Rows stream by; a task holds the open state only."""
    columns = [c.split()[0] for c in READS.split(", ")]
    keys = ["key"] if rules.merge_types else ["key", "lane"]
    rows = reads.select(*columns).withColumns({"reads": F.coalesce("reads", F.lit(0)).cast("long"), "lane": F.coalesce("event_type", F.lit(""))})
    placed = _stretches(rows, keys, rules.reach_us)

    def one(state: State, row: dict) -> tuple:
        kept = step(state, row["us"], row["id"], row["event_type"], _text(row["attacker"]), _text(row["victim"]), rules)
        return (*(row[c] for c in columns), kept)

    return fold_sorted(placed, [*keys, "stretch"], ["us", "id"], State, one, KEPT)


def dedup_variants(reads: DataFrame, variants: dict[str, DedupRules]) -> DataFrame:
    """(variant, key, id, us, kept_id) under several rule sets, in one pass over the rows."""
    placed = _stretches(reads, ["key"], max(r.reach_us for r in variants.values()))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["us", "id"])
        rows = list(zip(pdf["us"], pdf["id"], pdf["event_type"], map(_text, pdf["attacker"]), map(_text, pdf["victim"])))
        out = []
        for name, rules in variants.items():
            state = State()
            kept = pd.Series([step(state, *row, rules) for row in rows], index=pdf.index, dtype="Int64")
            out.append(pdf[["key", "id", "us"]].assign(variant=name, kept_id=kept))
        return pd.concat(out)[["variant", "key", "id", "us", "kept_id"]]

    schema = "variant string, key string, id long, us long, kept_id long"
    return placed.groupBy("key", F.floor(F.col("stretch") / STRETCHES_A_TASK)).applyInPandas(run, schema)


def fold_reads(kept: DataFrame) -> DataFrame:
    """The kept rows with the reads of all rows that count for them; ``kept`` is gone through once."""
    columns = [c.split()[0] for c in READS.split(", ") if not c.startswith("reads")]
    own = F.max(F.when(F.col("id") == F.col("kept_id"), F.struct(*columns)))
    grouped = kept.groupBy("kept_id").agg(own.alias("x"), F.sum("reads").alias("read_count"), F.count("*").alias("rows"))
    return grouped.where("x is not null").select("x.*", "read_count", "rows")


def stream_dedup(reads: DataFrame, rules: DedupRules = DedupRules()) -> DataFrame:
    """The same over a stream with event-time column ``ts``: rows wait for the watermark and leave it in order.

    ``reads``: READS and ``ts``; the caller sets the watermark.
    """
    import pickle

    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        plain, waiting = pickle.loads(held.get[0]) if held.exists else (State().dump(), [])
        state = State.load(plain)
        for pdf in batches:
            waiting += list(pdf[[c.split()[0] for c in READS.split(", ")]].itertuples(index=False, name=None))
        mark = held.getCurrentWatermarkMs() * 1000
        ready = sorted((r for r in waiting if r[2] <= mark), key=lambda r: (r[2], r[1]))
        waiting = [r for r in waiting if r[2] > mark]
        out = [(*r, step(state, r[2], r[1], r[3], r[4], r[5], rules)) for r in ready]
        if waiting or state.exact or state.chains or state.kept:
            held.update((pickle.dumps((state.dump(), waiting)),))
            soonest = min([r[2] for r in waiting], default=mark + rules.reach_us) // 1000 + 1
            held.setTimeoutTimestamp(max(soonest, held.getCurrentWatermarkMs() + 1))
        else:
            held.remove()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in KEPT.split(", ")])

    return reads.groupBy("key").applyInPandasWithState(run, KEPT, "state binary", "append", GroupStateTimeout.EventTimeTimeout)
