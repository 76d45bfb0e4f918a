"""Roles of transcript lines by a hidden Markov model, and canonical rendering of the turns.

A transcript is lines in order, without roles. A line shows a marker kind (which speaker word opens it, if any),
its length, how it ends and whether it opens a paragraph or the transcript. The hidden state is a role and
whether the line opens or goes on with a turn; Viterbi finds the likeliest states of the whole transcript.

A transcript of any length is cut into blocks of turns of lines. A block is summed up as the best value from
every state before it to every state at its end; the sums give the states at the cuts, and each block is then
decoded between them. The result is that of one pass, and no task holds more than a block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costweave.llm.shared import fit_in_task, table
from costweave.session import reuse

ROLES = ["system", "user", "assistant"]
STATES = [(role, opens) for role in ROLES for opens in (True, False)]
BLOCK_TURNS = 128  # source rows of a transcript that are decoded together
SAMPLE_TRANSCRIPTS = 4_000  # labelled transcripts for fitting (twice as many at most)
#: words that open a speaker's line (fixed values)
MARKERS = {
    "system": ["system", "instructions"], "user": ["user", "human", "q", "customer", "prompt"],
    "assistant": ["assistant", "ai", "bot", "a", "model", "gpt"],
}
_MARKER = re.compile(r"^\s*[>*#\[<|]*\s*([A-Za-z]{1,14})[\]>*|]*\s*:\s*")
_KIND = {word: k + 1 for k, role in enumerate(ROLES) for word in MARKERS[role]}
CELLS = [5, 8, 4, 3]  # values of each feature: marker, length, ending, place


def observe(text: str | None, first_of_all: bool, after_blank: bool) -> tuple[int, int, int, int]:
    """Features of a line: marker (none, one of the roles, other word), length, ending, place."""
    text = text or ""
    found = _MARKER.match(text)
    marker = _KIND.get(found.group(1).lower(), 4) if found else 0
    body = text[found.end() :] if found else text
    length = min(len(body).bit_length() // 1, 11)
    ending = {"?": 1, ".": 2}.get(body.rstrip()[-1:], 3) if body.strip() else 0
    return marker, max(0, length - 4), ending, 2 if first_of_all else int(after_blank)


def body_of(text: str | None) -> str:
    """The line without a known speaker word."""
    found = _MARKER.match(text or "")
    return (text or "")[found.end() :] if found and found.group(1).lower() in _KIND else text or ""


@dataclass
class RoleModel:
    start: np.ndarray  # log-probabilities
    move: np.ndarray  # from, to
    emit: list[np.ndarray]  # feature: value, state

    def values(self, lines: list[tuple]) -> np.ndarray:
        """Log-probability of every line's features under every state."""
        cells = np.array(lines, np.int64).reshape(-1, len(CELLS))
        return sum(self.emit[k][cells[:, k]] for k in range(len(CELLS)))

    def across(self, values: np.ndarray, first: bool) -> np.ndarray:
        """Best value from each state before a block (one row at the start of a transcript) to each at its end."""
        best = self.start[None] + values[0] if first else self.move + values[0]
        for value in values[1:]:
            best = (best[:, :, None] + self.move[None]).max(axis=1) + value
        return best

    def decode(self, values: np.ndarray, before: int | None, end: int) -> list[int]:
        """The best states of a block, from the state before it (None: start) to its last state."""
        best = (self.start if before is None else self.move[before]) + values[0]
        back = []
        for value in values[1:]:
            ways = best[:, None] + self.move
            back.append(ways.argmax(axis=0))
            best = ways.max(axis=0) + value
        states = [end]
        for way in reversed(back):
            states.append(int(way[states[-1]]))
        return states[::-1]


def fit_roles(sample: pd.DataFrame) -> RoleModel:
    """Smoothed counts of labelled lines (conv, at, state, f0..f3)."""
    sample = sample.sort_values(["conv", "at"], kind="stable")
    size = len(STATES)
    start, move = np.full(size, 0.1), np.full((size, size), 0.1)
    emit = [np.full((cells, size), 0.1) for cells in CELLS]
    state, conv = sample["state"].to_numpy(), sample["conv"].to_numpy()
    first = np.concatenate([[True], conv[1:] != conv[:-1]])
    np.add.at(start, state[first], 1)
    follows = np.flatnonzero(~first)
    np.add.at(move, (state[follows - 1], state[follows]), 1)
    for k in range(len(CELLS)):
        np.add.at(emit[k], (sample[f"f{k}"].to_numpy(), state), 1)
    # a turn cannot go on in another role
    for a, (role, _) in enumerate(STATES):
        for b, (other, opens) in enumerate(STATES):
            if not opens and role != other:
                move[a, b] = 1e-12
    start[[k for k, (_, opens) in enumerate(STATES) if not opens]] = 1e-12
    return RoleModel(
        np.log(start / start.sum()), np.log(move / move.sum(axis=1, keepdims=True)), [np.log(e / e.sum(axis=0)) for e in emit],
    )


def _blocks(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Whole groups of rows sorted by keys."""
    held: list[pd.DataFrame] = []
    last = None
    for frame in frames:
        if not len(frame):
            continue
        names = [frame[k].astype("object").where(frame[k].notna(), None) for k in keys]
        ids = list(zip(*names))
        cuts = [0, *(k for k in range(1, len(ids)) if ids[k] != ids[k - 1]), len(ids)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and ids[a] != last:
                yield last, pd.concat(held, ignore_index=True)
                held = []
            held.append(frame.iloc[a:b])
            last = ids[a]
    if held:
        yield last, pd.concat(held, ignore_index=True)


def _lines(block: pd.DataFrame, first_block: bool) -> tuple[list[tuple], list[str], list[int]]:
    """(features, text, source row) of the lines of a block; a source row after the first opens a paragraph."""
    features, texts, rows = [], [], []
    for number, text in enumerate(block["text"].tolist()):
        for k, line in enumerate((text or "").split("\n")):
            features.append(observe(line, first_block and not features, k == 0))
            texts.append(line)
            rows.append(number)
    return features, texts, rows


def parse(transcripts: DataFrame, model: RoleModel, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Turns of transcripts (conv_id, turn, text): conv_id, block, seq, first_turn, role, text, continued, rendered.

    Rows are paragraphs in the order of turn; each is split into lines, the model alone decides where turns
    begin. rendered is the canonical form, `<|role|>` and the text on the next lines. A turn that crosses blocks
    of block_turns rows has a row in each, marked continued. NULL texts are empty lines; a NULL conv_id is a
    transcript of its own, NULL turns come first in block 0; rows with equal turn are ordered by text.
    """
    block = F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(0)).cast("long")
    rows = transcripts.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "text")
    rows = rows.withColumn("block", block)
    first = rows.groupBy("conv_id").agg(F.min("block").alias("least"))
    rows = reuse(
        rows.join(first, rows["conv_id"].eqNullSafe(first["conv_id"])).select(rows["*"], (F.col("block") == F.col("least")).alias("opening"))
        .repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "text")
    )
    size = len(STATES)

    def sum_up(frames):
        out = []
        for (conv_id, number), own in _blocks(frames, ["conv_id", "block"]):
            opening = bool(own["opening"].iloc[0])
            best = model.across(model.values(_lines(own, opening)[0]), opening)
            out.append((conv_id, number, best.ravel().tolist()))
        yield pd.DataFrame(out, columns=["conv_id", "block", "best"])

    def ends(frames):
        out = []
        for (conv_id, _), own in _blocks(((f.assign(one=0) for f in frames)), ["conv_id", "one"]):
            value, ways = np.zeros(1), []
            for best in own["best"]:
                table_ = value[:, None] + np.array(best).reshape(-1, size)
                ways.append(table_.argmax(axis=0).astype(np.int8))
                value = table_.max(axis=0)
            state = int(value.argmax())
            for number, way in zip(own["block"].tolist()[::-1], ways[::-1]):
                before = int(way[state])
                out.append((conv_id, number, before, state))
                state = before
        yield pd.DataFrame(out, columns=["conv_id", "block", "before", "end"])

    dealt = rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "text")
    sums = dealt.mapInPandas(sum_up, "conv_id long, block long, best array<double>")
    cuts = sums.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInPandas(
        ends, "conv_id long, block long, before int, end int"
    )
    cuts = cuts.withColumnsRenamed({"conv_id": "_conv", "block": "_block"})
    known = rows.join(cuts, rows["conv_id"].eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block"))).drop("_conv", "_block")

    def tell(frames):
        out = []
        for (conv_id, number), own in _blocks(frames, ["conv_id", "block"]):
            opening = bool(own["opening"].iloc[0])
            features, texts, source = _lines(own, opening)
            states = model.decode(model.values(features), None if opening else int(own["before"].iloc[0]), int(own["end"].iloc[0]))
            turns: list[list] = []
            for state, text, row in zip(states, texts, source):
                role, opens = STATES[state]
                if opens or not turns:
                    turns.append([role, not opens, own["turn"].iloc[row], [body_of(text)]])
                else:
                    turns[-1][3].append(text)
            for seq, (role, continued, turn, lines) in enumerate(turns):
                text = "\n".join(lines)
                out.append((conv_id, number, seq, None if pd.isna(turn) else int(turn), role, text, continued, f"<|{role}|>\n{text}"))
            if len(out) >= 5_000:
                yield frame_of(out)
                out = []
        yield frame_of(out)

    def frame_of(out):
        names = ["conv_id", "block", "seq", "first_turn", "role", "text", "continued", "rendered"]
        frame = pd.DataFrame(out, columns=names)
        return frame.astype({"conv_id": "Int64", "block": "Int64", "seq": "Int64", "first_turn": "Int64"})

    again = known.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "text")
    return again.mapInPandas(
        tell, "conv_id long, block long, seq long, first_turn long, role string, text string, continued boolean, rendered string"
    )


def train(labelled: DataFrame, sample: int = SAMPLE_TRANSCRIPTS) -> RoleModel | None:
    """Fit on transcripts with roles (conv_id, turn, role, text); rows with other roles are left out.

    Bounded sample: about `sample` conversations, by hash of conv_id, of each at most the turns below
    BLOCK_TURNS. None if there are no labelled rows.
    """
    rows = labelled.where(F.col("role").isin(ROLES) & F.col("conv_id").isNotNull() & (F.col("turn") < BLOCK_TURNS))
    total = rows.select("conv_id").distinct().count()
    if not total:
        return None
    share = min(1.0, sample / total)
    chosen = rows.where(F.pmod(F.xxhash64("conv_id"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def measure(frames):
        for frame in frames:
            out = []
            for conv_id, turn, role, text, opening in frame.itertuples(index=False):
                for k, line in enumerate((text or "").split("\n")):
                    cells = observe(line, bool(opening) and k == 0, k == 0)
                    out.append((conv_id, turn * 1_000_000 + k, STATES.index((role, k == 0)), *cells))
            yield pd.DataFrame(out, columns=["conv", "at", "state", "f0", "f1", "f2", "f3"])

    first = chosen.groupBy("conv_id").agg(F.min("turn").alias("least"))
    lines = chosen.join(first, "conv_id").select("conv_id", "turn", "role", "text", (F.col("turn") == F.col("least")).alias("opening"))
    measured = lines.mapInPandas(measure, "conv long, at long, state int, f0 int, f1 int, f2 int, f3 int")
    return fit_in_task(measured, fit_roles)


def as_transcripts(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) as they are met in the wild: conv_id, turn, role, text with markers.

    The style of a conversation follows from its conv_id: full words, short words, or none; every seventh turn
    lacks its marker. NULL or other roles have no marker.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    words = [("User: ", "Assistant: ", "System: "), ("Human: ", "AI: ", "Instructions: "), ("Q: ", "A: ", "")]
    marker = F.lit("")
    for k, (user, assistant, system) in enumerate(words):
        own = F.when(F.col("role") == "user", user).when(F.col("role") == "assistant", assistant).when(F.col("role") == "system", system)
        marker = F.when(style == k, own).otherwise(marker)
    lost = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(7)) == 0
    text = F.concat(F.when(lost, "").otherwise(F.coalesce(marker, F.lit(""))), F.coalesce("text", F.lit("")))
    return conversations.select("conv_id", "turn", "role", text.alias("text"))


def recover_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as transcripts, parsed again without their roles."""
    wild = as_transcripts(table(spark, sf_dir, "conversations"))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    model = train(wild.where(~held_out)) or RoleModel(
        np.zeros(len(STATES)), np.zeros((len(STATES),) * 2), [np.zeros((n, len(STATES))) for n in CELLS]
    )
    return parse(wild.drop("role"), model)
