"""Transcript parsing: roles of lines by a hidden Markov model, then canonical turns.

States are the roles.  A line shows a marker (a speaker's name, or none), whether a turn of the
source begins there, and coarse features of its text.  Probabilities are counted by Spark over the
lines whose marker names a role; Viterbi then decides for every line, marked or not.

A conversation of any length is decoded in blocks: each block becomes a matrix of best scores from
role to role, the few matrices of a conversation are chained, and each block is then traced between
the roles chosen at its ends.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from phasegrid.sources import storage

ROLES = ("system", "user", "assistant", "tool")
# Names that transcripts use for the speakers.
ALIASES = {
    "system": ("system", "sys", "instructions"),
    "user": ("user", "human", "customer", "question", "prompter", "me"),
    "assistant": ("assistant", "ai", "bot", "agent", "answer", "gpt", "model"),
    "tool": ("tool", "function", "observation"),
}
NONE = len(ROLES)
TURNS_PER_BLOCK, ROWS_PER_BLOCK, ROWS_PER_TASK = 128, 4096, 8192
# Weight of a marker against everything else: the chance that a marker is wrong.
MARKER_ERROR = 0.002
# Features of a line's text: length class (4) times question mark (2) times list or code sign (2).
FEATURES = 16


# A speaker's name before a colon, or alone behind a sign of a heading, bold type, bracket or tag.  A
# bare word on a line is text.
_PREFIX, _NAME = r"(?:#{1,4}\s*|\*\*|\[|<\|(?:im_start\|>)?)", r"([A-Za-z]{2,12})"
_SPOKEN = rf"^\s*{_PREFIX}?{_NAME}(?:\s*\*\*)?\s*:\s*(?:\*\*\s*)?"
_HEADED = rf"^\s*{_PREFIX}{_NAME}(?:\s*\*\*)?(?:\s*:\s*|\|>?|\]|\s*$)\s*(?:\*\*\s*)?"


def marker_of(line: Column) -> Column:
    """Number of the role that a line's head names (``User: ...``, ``### Assistant``, ``<|user|>``), else NONE."""
    spoken = F.regexp_extract(line, _SPOKEN, 1)
    head = F.lower(F.when(spoken != "", spoken).otherwise(F.regexp_extract(line, _HEADED, 1)))
    out = F.lit(NONE)
    for number, role in enumerate(ROLES):
        out = F.when(head.isin(*ALIASES[role]), number).otherwise(out)
    return out


def without_marker(line: Column) -> Column:
    bare = F.when(F.regexp_extract(line, _SPOKEN, 1) != "", F.regexp_replace(line, _SPOKEN, "")).otherwise(
        F.regexp_replace(line, _HEADED, ""))
    return F.when(marker_of(line) < NONE, bare).otherwise(line)


def _named(role: Column) -> Column:
    out = F.lit(NONE)
    for number, name in enumerate(ROLES):
        out = F.when(F.lower(F.trim(role)).isin(*ALIASES[name]), number).otherwise(out)
    return out


def lines(df: DataFrame, conv_col: str, turn_col: str, role_col: str | None, text_col: str) -> DataFrame:
    """conv, turn, row, no, line, marker, starts, feature: the lines of all turns in order.

    A turn's first line carries the turn's speaker label as its marker unless the line names one.
    """
    conv = F.coalesce(F.concat(F.lit("c"), F.col(conv_col).cast("string")),
                      F.concat(F.lit("r"), F.xxhash64(turn_col, text_col).cast("string")))
    label = _named(F.col(role_col)) if role_col else F.lit(NONE)
    slim = df.select(
        conv.alias("conv"), F.col(conv_col).alias("conv_id"), F.coalesce(F.col(turn_col).cast("long"), F.lit(1 << 62)).alias("turn"),
        label.alias("label"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).distinct().withColumn("row", F.xxhash64("text", "label"))
    cut = slim.select("conv", "conv_id", "turn", "row", "label", F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))
    size = F.length("line")
    feature = (
        F.when(size < 20, 0).when(size < 80, 1).when(size < 240, 2).otherwise(3) * 4
        + F.when(F.col("line").contains("?"), 2).otherwise(0)
        + F.when(F.col("line").rlike(r"^\s*(?:[-*•]|\d+[.)]|```|    )"), 1).otherwise(0)
    )
    first = F.col("no") == 0
    own = marker_of(F.col("line"))
    return cut.select(
        "conv", "conv_id", "turn", "row", "no", without_marker(F.col("line")).alias("line"),
        F.when(own < NONE, own).when(first, F.col("label")).otherwise(NONE).cast("int").alias("marker"),
        (first | (own < NONE)).cast("int").alias("starts"), feature.cast("int").alias("feature"),
    )


def fit(rows: DataFrame) -> dict[str, np.ndarray]:
    """Log probabilities: initial, next[starts] (role x role), marker and feature (role x value).

    Counted over marked lines; the step from one turn to the next over neighbouring marked turns of
    a conversation.  All counts are smoothed, so an empty table gives even odds.
    """
    k = len(ROLES)
    feature = np.full((k, FEATURES), 1.0)
    for r in rows.where(f"marker < {NONE}").groupBy("marker", "feature").count().collect():  # 64 rows at most
        feature[r["marker"], r["feature"]] += r["count"]
    marked = rows.where(f"marker < {NONE}").select("conv", "turn", "marker").distinct()
    after = marked.select("conv", (F.col("turn") + 1).alias("turn"), F.col("marker").alias("prior"))
    step = np.full((k, k), 0.5)
    for r in marked.join(after, ["conv", "turn"]).groupBy("prior", "marker").count().collect():
        step[r["prior"], r["marker"]] += r["count"]
    first = np.full(k, 0.5)
    for r in marked.where("turn = 0").groupBy("marker").count().collect():
        first[r["marker"]] += r["count"]
    silent = 0.25
    marker = np.full((k, k + 1), MARKER_ERROR / k * (1 - silent))
    marker[np.arange(k), np.arange(k)] = (1 - MARKER_ERROR) * (1 - silent)
    marker[:, k] = silent
    stay = np.full((k, k), 1e-6)
    stay[np.arange(k), np.arange(k)] = 1.0
    norm = lambda a: np.log(a / a.sum(-1, keepdims=True))
    return {"initial": norm(first), "stay": norm(stay), "step": norm(step), "marker": norm(marker), "feature": norm(feature)}


def _emissions(t: pa.Table, model: dict) -> np.ndarray:
    """Score of each line in each role.  Only a turn's first line weighs by its marker."""
    marker, feature = t["marker"].to_numpy(), t["feature"].to_numpy()
    return model["marker"][:, marker].T * (t["starts"].to_numpy() > 0)[:, None] + 0.2 * model["feature"][:, feature].T


def _in_order(t: pa.Table) -> tuple[pa.Table, list[int]]:
    """Rows by block and order, and the begins of the blocks."""
    t = t.sort_by([(c, "ascending") for c in ("conv", "block", "turn", "row", "no")])
    conv, block = t["conv"].to_pylist(), t["block"].to_pylist()
    begins = [i for i in range(len(conv)) if i == 0 or conv[i] != conv[i - 1] or block[i] != block[i - 1]]
    return t, [*begins, len(conv)]


def viterbi(emission: np.ndarray, starts: np.ndarray, model: dict, entry: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Best scores by last role and the back pointers; entry: scores before the first line by role."""
    score, back = entry, []
    for e, s in zip(emission, starts, strict=True):
        through = score[:, None] + (model["step"] if s else model["stay"])
        back.append(through.argmax(0))
        score = through.max(0) + e
    return score, back


def decode(rows: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """``rows`` with ``role``, the most likely role of each line in its conversation."""
    spark = rows.sparkSession
    # Blocks of a conversation: by turns, and by rows inside turns that hold very many.
    by_turn = rows.withColumn("tb", F.floor(F.col("turn") / TURNS_PER_BLOCK))
    per_turn = by_turn.groupBy("conv", "tb", "turn").agg(F.count(F.lit(1)).alias("c"))
    crowded = per_turn.groupBy("conv", "tb").agg(F.sum("c").alias("all")).where(F.col("all") > ROWS_PER_BLOCK)
    wide = per_turn.join(crowded, ["conv", "tb"]).select("conv", "turn", F.ceil(F.col("c") / ROWS_PER_BLOCK).alias("parts"))
    share = (F.col("row") / F.lit(2.0**64) + 0.5) * F.col("parts")
    blocks = by_turn.join(wide, ["conv", "turn"], "left").withColumn(
        "block",
        F.format_string("%020d.%020d.%08d", "tb", F.when(F.col("parts").isNull(), F.lit(0).cast("long")).otherwise(F.col("turn")),
                        F.coalesce(F.least(F.floor(share), F.col("parts") - 1), F.lit(0).cast("long"))),
    ).drop("tb", "parts")
    blocks = storage.save(blocks, storage.new_path(spark, "chat-lines"))
    tasks = max(1, math.ceil(blocks.count() / ROWS_PER_TASK))
    dealt = blocks.withColumn("task", F.pmod(F.xxhash64("conv", "block"), F.lit(tasks)))
    k = len(ROLES)

    def squeeze(t: pa.Table) -> pa.Table:
        t, begins = _in_order(t)
        emission, starts = _emissions(t, model), t["starts"].to_numpy()
        paths = []
        for lo, hi in zip(begins[:-1], begins[1:], strict=True):
            outs = []
            for role in range(k):
                entry = np.full(k, -np.inf)
                entry[role] = 0.0
                outs.append(viterbi(emission[lo:hi], starts[lo:hi], model, entry)[0])
            paths.append(np.concatenate(outs).tolist())
        at = pa.array(begins[:-1])
        return pa.table({"conv": t["conv"].take(at), "block": t["block"].take(at), "best": pa.array(paths, pa.list_(pa.float64()))})

    matrices = dealt.groupBy("task").applyInArrow(squeeze, "conv string, block string, best array<double>")
    several = storage.save(matrices, storage.new_path(spark, "chat-blocks"))
    chains = several.withColumn("task", F.pmod(F.xxhash64("conv"), F.lit(tasks)))

    def chain(t: pa.Table) -> pa.Table:
        t = t.sort_by([("conv", "ascending"), ("block", "ascending")])
        conv, best = t["conv"].to_pylist(), np.array(t["best"].to_pylist()).reshape(-1, k, k)
        entry, leave = np.zeros(len(conv), int), np.zeros(len(conv), int)
        lo = 0
        while lo < len(conv):
            hi = lo
            while hi < len(conv) and conv[hi] == conv[lo]:
                hi += 1
            score, back = model["initial"], []
            for i in range(lo, hi):
                through = score[:, None] + best[i]
                back.append(through.argmax(0))
                score = through.max(0)
            role = int(score.argmax())
            for i in range(hi - 1, lo - 1, -1):
                leave[i] = role
                role = int(back[i - lo][role])
                entry[i] = role
            lo = hi
        return pa.table({"conv": t["conv"], "block": t["block"], "entry": pa.array(entry, pa.int32()), "leave": pa.array(leave, pa.int32())})

    ends = chains.groupBy("task").applyInArrow(chain, "conv string, block string, entry int, leave int")
    traced = dealt.join(ends, ["conv", "block"])

    def trace(t: pa.Table) -> pa.Table:
        t, begins = _in_order(t)
        emission, starts = _emissions(t, model), t["starts"].to_numpy()
        entry, leave = t["entry"].to_numpy(), t["leave"].to_numpy()
        roles = np.zeros(len(t), np.int32)
        for lo, hi in zip(begins[:-1], begins[1:], strict=True):
            before = np.full(k, -np.inf)
            before[entry[lo]] = 0.0
            _, back = viterbi(emission[lo:hi], starts[lo:hi], model, before)
            role = int(leave[lo])
            for i in range(hi - 1, lo - 1, -1):
                roles[i] = role
                role = int(back[i - lo][role])
        names = pa.array([ROLES[r] for r in roles.tolist()], pa.string())
        return t.select(["conv", "conv_id", "block", "turn", "row", "no", "line", "starts"]).append_column("role", names)

    kind = dict(rows.dtypes)
    return traced.groupBy("task").applyInArrow(
        trace, f"conv string, conv_id {kind['conv_id']}, block string, turn long, row long, no int, line string, starts int, role string"
    )


def parse(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str | None = "role",
          text_col: str = "text") -> DataFrame:
    """conv_id, turn, part, role, text and rendered of each recovered turn.

    A speaker label or in-line marker is evidence, not truth: unlabelled and mislabelled turns get
    the role the model finds.  A source turn splits into several parts where a line names another
    speaker; part counts them from 0.  rendered is ``<|role|>``, the trimmed text and ``<|end|>`` on
    lines of their own.  Repeated equal rows are one turn; turns of equal number follow each other
    in a fixed order; null turns come last; a row without a conversation id is a conversation of
    its own; null texts are empty.  An empty table gives no rows.
    """
    spark = df.sparkSession
    rows = storage.save(lines(df, conv_col, turn_col, role_col, text_col), storage.new_path(spark, "chat-split"))
    named = decode(rows, fit(rows))
    # Parts of one source turn: a part begins at the turn's first line and at each marker.
    begin = F.when(F.col("starts") == 1, F.col("no")).otherwise(F.lit(None))
    parts = (
        named.groupBy("conv", "conv_id", "turn", "row")
        .agg(F.array_sort(F.collect_list(F.struct("no", "line", "role", begin.alias("begin")))).alias("all"))
        .withColumn("heads", F.array_sort(F.array_distinct(F.filter(F.transform("all", lambda x: x["begin"]), lambda b: b.isNotNull()))))
        .select("*", F.posexplode("heads").alias("part", "head"))
    )
    until = F.coalesce(F.get("heads", F.col("part") + 1), F.lit(1 << 30))
    own = F.filter("all", lambda x: (x["no"] >= F.col("head")) & (x["no"] < until))
    text = F.trim(F.array_join(F.transform(own, lambda x: x["line"]), "\n"))
    out = parts.select(
        F.col("conv_id").alias(conv_col), F.when(F.col("turn") < (1 << 62), F.col("turn")).alias(turn_col), F.col("row"),
        "part", F.element_at(own, 1)["role"].alias("role"), text.alias("text"),
    )
    return out.withColumn("rendered", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>")))
