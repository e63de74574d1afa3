"""Chat transcripts to turns: a hidden Markov model over speaker markers and line features, decoded by Viterbi.

States are a role's first line and its further lines, for each role. A line shows a marker class (which kind of speaker
its opening words name, if any) and a few features of its text. Transition and emission counts may be learned from
labelled turns; the defaults hold without.

Viterbi's recursion is a product of max-plus matrices, so a transcript is cut into blocks of LINES lines, each block's
matrix is computed by itself, matrices are multiplied in levels of FAN, and the best path's states at the block borders are
found level by level downwards. A transcript with a third of all lines, or a turn with that many, is spread over as many
tasks as it has blocks; only a summary of each block is gathered by transcript.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Batches, batches, ddl, emit, table

ROLES = ("system", "user", "assistant")
K = 2 * len(ROLES)  # role r opens in state 2 r and goes on in 2 r + 1
START = K
LINES, FAN = 256, 64
#: Turns that are numbered in one place have the same number but for so many bits.
TURN_BITS = 6
# Opening words by role. A marker ends in a colon or closes a bracket, or is a heading of its own.
MARKERS = {
    "system": ("system", "sys", "instructions", "context"),
    "user": ("user", "human", "you", "q", "question", "customer", "prompter", "me"),
    "assistant": ("assistant", "ai", "bot", "a", "answer", "model", "agent", "response"),
}
ROLE_OF = {w: i for i, r in enumerate(ROLES) for w in MARKERS[r]}
MARKER = re.compile(r"\s*(?:<\|(\w+)\|>|\[(\w+)\]|#{1,6}\s*(\w+):?\s*$|\**(\w+)\**\s*:(?=\s|$))\s*", re.I)
SHORT, LONG = 40, 200


def marker_of(line: str) -> tuple[int, str]:
    """(role number, or 3 for none; the line without its marker)."""
    m = MARKER.match(line)
    role = ROLE_OF.get(next((g for g in m.groups() if g), "").lower()) if m else None
    return (3, line) if role is None else (role, line[m.end() :])


def features(line: str, gap: bool) -> tuple[int, ...]:
    """Marker class; length class; ends in a question mark; opens like a list item, code or quotation; follows a blank line."""
    role, rest = marker_of(line)
    return role, (0 if not rest.strip() else 1 if len(rest) < SHORT else 2 if len(rest) < LONG else 3), int(rest.rstrip().endswith("?")), int(bool(re.match(r"\s*(?:[-*>]|\d+[.)]|```|\s{4})", rest))), int(gap)


SIZES = (4, 4, 2, 2, 2)


class Model:
    """Log scores: moves (START and states x states), shows[feature] (states x values)."""

    def __init__(self, turns: dict | None = None, lines: dict | None = None):
        """turns: counts of (role before or -1, role); lines: counts of (role, first line or not, feature number, value)."""
        roles = np.full((len(ROLES) + 1, len(ROLES)), 0.5)
        roles[-1] = (2, 4, 0.5)
        roles[0], roles[1], roles[2] = (0.1, 4, 1), (0.05, 0.3, 4), (0.05, 4, 0.3)
        for (a, b), n in (turns or {}).items():
            roles[a, b] += n
        roles /= roles.sum(1, keepdims=True)
        first = np.full((len(ROLES), 2), 3.0)
        shows = [np.ones((K, n)) for n in SIZES]
        for r in range(len(ROLES)):
            shows[0][2 * r] = [30.0 if i == r else 0.3 if i < 3 else 12.0 for i in range(4)]
            shows[0][2 * r + 1] = (0.1, 0.1, 0.1, 60.0)
            shows[4][2 * r], shows[4][2 * r + 1] = (1, 9), (30, 1)
        shows[2][2], shows[2][3] = (3, 3), (4, 2)  # users ask
        shows[2][0] = shows[2][1] = shows[2][4] = shows[2][5] = (6, 1)
        shows[3][5] = (3, 2)  # assistants list
        for (r, opens, f, v), n in (lines or {}).items():
            shows[f][2 * r + (not opens), v] += n
            if f == 1:
                first[r, 0 if opens else 1] += n
        self.shows = [np.log(x / x.sum(1, keepdims=True)) for x in shows]
        moves = np.full((K + 1, K), -np.inf)
        for r in range(len(ROLES)):
            moves[START, 2 * r] = math.log(roles[-1, r])
            end = first[r, 0] / first[r].sum()  # of a role's lines, this share are its turns' last
            for s in (2 * r, 2 * r + 1):
                moves[s, 2 * r + 1] = math.log(1 - end)
                for q in range(len(ROLES)):
                    moves[s, 2 * q] = math.log(end * roles[r, q])
        self.moves = moves

    def step(self, row: dict) -> np.ndarray:
        """(K + 1) x (K + 1) scores of going over a line from each state to each."""
        out = np.full((K + 1, K + 1), -np.inf)
        out[:, :K] = self.moves + sum(s[:, v] for s, v in zip(self.shows, features(row["line"], row["gap"])))
        return out


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None]).max(1)


def through(steps: list[np.ndarray], enter: int, leave: int | None) -> list[int]:
    """States after each step of the best path from enter to leave (None: wherever is best); the smallest state wins ties."""
    score, back = np.full(K + 1, -np.inf), []
    score[enter] = 0
    for m in steps:
        every = score[:, None] + m
        back.append(every.argmax(0))
        score = every.max(0)
    at, path = int(score.argmax()) if leave is None else leave, []
    for b in reversed(back):
        path.append(at)
        at = int(b[at])
    return path[::-1]


def groups(it: Batches, keys: list[str]):
    """Rows of sorted input, as dicts, by equal keys; one group is held at a time."""
    now, held = None, []
    for b in it:
        for row in b.to_pylist():
            key = tuple(row[k] for k in keys)
            if held and key != now:
                yield now, held
                held = []
            now = key
            held.append(row)
    if held:
        yield now, held


def lay(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, order)


def in_batches(schema: pa.Schema, rows, size: int = 2000) -> Batches:
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield emit(schema, *map(list, zip(*held)))
            held = []
    if held:
        yield emit(schema, *map(list, zip(*held)))


def decode(lines: DataFrame, model: Model) -> DataFrame:
    """(conv_id, block, pos, line, gap) -> with state, the best path's. blocks ascend with pos; gap: a blank line is before."""
    node = batches({"conv_id": pa.int64(), "idx": pa.int64(), "m": pa.binary()})
    border = batches({"conv_id": pa.int64(), "idx": pa.int64(), "enter": pa.int32(), "leave": pa.int32()})
    out = batches({"conv_id": pa.int64(), "block": pa.int64(), "pos": pa.int64(), "state": pa.int32(), "line": pa.string()})
    shape = (K + 1, K + 1)

    def leaves(it: Batches) -> Batches:
        def rows():
            for (conv, block), held in groups(it, ["conv_id", "block"]):
                m = model.step(held[0])
                for r in held[1:]:
                    m = times(m, model.step(r))
                yield conv, block, m.tobytes()

        return in_batches(node, rows())

    def combine(it: Batches) -> Batches:
        def rows():
            for (conv, up), held in groups(it, ["conv_id", "up"]):
                m = np.frombuffer(held[0]["m"]).reshape(shape)
                for r in held[1:]:
                    m = times(m, np.frombuffer(r["m"]).reshape(shape))
                yield conv, up, m.tobytes()

        return in_batches(node, rows())

    def descend(it: Batches) -> Batches:
        def rows():
            for (conv, _), held in groups(it, ["conv_id", "up"]):
                path = through([np.frombuffer(r["m"]).reshape(shape) for r in held], held[0]["enter"], None if held[0]["leave"] < 0 else held[0]["leave"])
                for r, a, b in zip(held, [held[0]["enter"], *path], path):
                    yield conv, r["idx"], a, b

        return in_batches(border, rows())

    def states(it: Batches) -> Batches:
        def rows():
            for (conv, block), held in groups(it, ["conv_id", "block"]):
                path = through([model.step(r) for r in held], held[0]["enter"], None if held[0]["leave"] < 0 else held[0]["leave"])
                for r, s in zip(held, path):
                    yield conv, block, r["pos"], s, r["line"]

        return in_batches(out, rows())

    up = F.floor(F.col("idx") / FAN).cast("long").alias("up")
    highest = lines.agg(F.max("block")).first()[0] or 0
    levels = []
    if highest:
        levels.append(table(lay(lines, ["conv_id", "block"], "pos").mapInArrow(leaves, ddl(node)), "blocks"))
        while highest >= FAN:
            levels.append(table(lay(levels[-1].select("conv_id", "idx", "m", up), ["conv_id", "up"], "idx").mapInArrow(combine, ddl(node)), "level"))
            highest //= FAN
    known = None
    for level in reversed(levels):
        own = level.select(F.col("conv_id"), "idx", "m", up)
        if known is None:
            own = own.withColumn("enter", F.lit(START)).withColumn("leave", F.lit(-1))
        else:
            k = known.select(F.col("conv_id").alias("k_id"), F.col("idx").alias("k_up"), "enter", "leave")
            own = own.join(k, F.col("conv_id").eqNullSafe(F.col("k_id")) & (F.col("up") == F.col("k_up"))).drop("k_id", "k_up")
        known = table(lay(own, ["conv_id", "up"], "idx").mapInArrow(descend, ddl(border)), "borders")
    if known is None:
        lines = lines.withColumn("enter", F.lit(START)).withColumn("leave", F.lit(-1))
    else:
        k = known.select(F.col("conv_id").alias("k_id"), "idx", "enter", "leave")
        lines = lines.join(k, F.col("conv_id").eqNullSafe(F.col("k_id")) & (F.col("block") == F.col("idx"))).drop("k_id", "idx")
    return lay(lines, ["conv_id", "block"], "pos").mapInArrow(states, ddl(out))


def transcripts(turns: DataFrame) -> DataFrame:
    """Labelled turns (conv_id, turn, role, text) as unlabelled transcript lines: conv_id, block, pos, line, gap, turn.

    A blank line ends each turn. Four turns in five open with a marker, in one of several spellings by a hash of conv_id and
    turn; the others have none. pos numbers the lines of a transcript from 0. Turns go by their number, of whatever sign and
    with whatever gaps; rows without a number come first, and they, like rows that repeat a number, in an order by role and
    text. Null texts are one empty line, null roles have no marker, a null conv_id is a transcript like others.
    """
    h = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(10))
    spelled = F.when(F.col("role") == "user", F.element_at(F.array(*map(F.lit, ("User: ", "Human: ", "### Question\n", "**You**: "))), (h % 4 + 1).cast("int")))
    spelled = spelled.when(F.col("role") == "assistant", F.element_at(F.array(*map(F.lit, ("Assistant: ", "AI: ", "### Answer\n", "**Bot**: "))), (h % 4 + 1).cast("int")))
    spelled = spelled.when(F.col("role") == "system", F.lit("[system] "))
    content = F.xxhash64("role", "text")
    chunk = F.when(F.col("turn").isNull(), F.lit(-(1 << 62)) + F.pmod(content, F.lit(1024))).otherwise(F.shiftright("turn", TURN_BITS))
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    written = F.concat(F.when(h < 8, F.coalesce(spelled, F.lit(""))).otherwise(F.lit("")), F.coalesce("text", F.lit("")), F.lit("\n"))
    t = t.withColumn("chunk", chunk).withColumn("content", content).withColumn("written", written)
    t = t.withColumn("n", F.length("written") - F.length(F.replace("written", F.lit("\n"), F.lit(""))) + 1)
    # Lines before a row: within its chunk, and in the chunks before.
    ahead = Window.partitionBy("conv_id", "chunk").orderBy(F.col("turn").asc_nulls_first(), "content", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy("c_id").orderBy("c_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = t.groupBy(F.col("conv_id").alias("c_id"), F.col("chunk").alias("c_chunk")).agg(F.sum("n").alias("lines"))
    chunks = table(chunks.withColumn("above", F.coalesce(F.sum("lines").over(above), F.lit(0))).drop("lines"), "chunks")
    t = t.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).join(chunks, F.col("conv_id").eqNullSafe(F.col("c_id")) & (F.col("chunk") == F.col("c_chunk")))
    lines = F.split("written", "\n", -1)
    pairs = F.zip_with(lines, F.concat(F.array(F.lit("")), lines), lambda x, before: F.struct(x.alias("line"), (before == "").alias("gap")))
    each = t.select("conv_id", "turn", (F.col("above") + F.col("ahead")).alias("first"), F.posexplode(pairs).alias("at", "x")).where("x.line is not null")
    pos = F.col("first") + F.col("at")
    gap = F.when(F.col("at") == 0, F.col("first") > 0).otherwise(F.col("x.gap"))
    return each.select("conv_id", F.floor(pos / LINES).cast("long").alias("block"), pos.alias("pos"), F.col("x.line").alias("line"), gap.alias("gap"), "turn")


def learn(turns: DataFrame) -> Model:
    """A model from labelled turns: counts over all of them, of role pairs and of line features (a bounded number of each).

    Turns without a number are in no pair; other roles, null ones too, and an empty table add nothing. Repeated rows count again.
    """
    t = turns.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")).alias("r")).where("r > 0")
    n = t.select(F.col("conv_id").alias("n_id"), (F.col("turn") - 1).alias("n_turn"), F.col("r").alias("n_r"))
    pairs = {(int(x.r) - 1, int(x.n_r) - 1): x["count"] for x in t.join(n, (F.col("conv_id") == F.col("n_id")) & (F.col("turn") == F.col("n_turn"))).groupBy("r", "n_r").count().collect()}
    pairs |= {(-1, int(x.r) - 1): x["count"] for x in t.where("turn = 0").groupBy("r").count().collect()}  # turns are numbered from 0
    seen = batches({"role": pa.int64(), "opens": pa.int64(), "f": pa.int64(), "v": pa.int64(), "n": pa.int64()})

    def count(it: Batches) -> Batches:
        total: dict = {}
        for b in it:
            for role, text in zip(b.column("role").to_pylist(), b.column("text").to_pylist()):
                if role in ROLES:
                    for i, line in enumerate((text or "").split("\n")):
                        for f, v in enumerate(features(line, False)):
                            if f not in (0, 4) or (i and not f):  # texts have no markers, and what ends a turn isn't theirs
                                key = (ROLES.index(role), int(not i), f, v)
                                total[key] = total.get(key, 0) + 1
        if total:
            yield emit(seen, *map(list, zip(*((*k, n) for k, n in total.items()))))

    rows = turns.select(F.col("role").cast("string"), F.col("text").cast("string")).mapInArrow(count, ddl(seen)).groupBy("role", "opens", "f", "v").agg(F.sum("n").alias("n")).collect()
    lines = {(r.role, bool(r.opens), r.f, r.v): r.n for r in rows}
    return Model(pairs, lines)


def parse(lines: DataFrame, model: Model) -> DataFrame:
    """Turns of transcripts: conv_id, start (pos of its first line), role, n_lines, rendered.

    lines: conv_id, block, pos, line, gap (see transcripts()); other columns are ignored. A turn is rendered as <|role|>, its
    lines without the marker, and <|end|>, each on lines of its own; it is one string, so one row holds it. Lines that repeat a
    pos stay, in any order; a null line is an empty one, a null conv_id is a transcript like others. Empty in, empty out.
    """
    lines = lines.select("conv_id", "block", "pos", F.coalesce("line", F.lit("")).alias("line"), F.coalesce("gap", F.lit(False)).alias("gap"))
    found = table(decode(lines, model), "states")
    opens = F.col("state") % 2 == 0
    # A block's first lines may belong to a turn that opened in a block before: the last one that opened there, from a row for each block.
    above = Window.partitionBy("b_id").orderBy("b_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = found.groupBy(F.col("conv_id").alias("b_id"), F.col("block").alias("b_block")).agg(F.max(F.when(opens, F.col("pos"))).alias("last"))
    blocks = table(blocks.select("b_id", "b_block", F.max("last").over(above).alias("above")), "blocks")
    here = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = found.withColumn("start", F.max(F.when(opens, F.col("pos"))).over(here)).join(blocks, F.col("conv_id").eqNullSafe(F.col("b_id")) & (F.col("block") == F.col("b_block")))
    marked = marked.withColumn("start", F.coalesce("start", "above"))
    role = F.element_at(F.array(*map(F.lit, ROLES)), F.floor(F.min_by("state", "pos") / 2).cast("int") + 1)
    out = batches({"conv_id": pa.int64(), "start": pa.int64(), "role": pa.string(), "n_lines": pa.int64(), "rendered": pa.string()})
    turns = marked.groupBy("conv_id", "start").agg(role.alias("role"), F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    flat = turns.select("conv_id", "start", "role", F.transform("lines", lambda x: x["line"]).alias("lines"))

    def render(it: Batches) -> Batches:
        for b in it:
            rows = []
            for c, s, r, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                head = marker_of(text[0])[1]
                body = ([head] if head or len(text) == 1 else []) + text[1:]
                while body and not body[-1].strip():
                    body.pop()
                rows.append((c, s, r, len(text), "\n".join([f"<|{r}|>", *body, "<|end|>"])))
            if rows:
                yield emit(out, *map(list, zip(*rows)))

    return flat.mapInArrow(render, ddl(out))
