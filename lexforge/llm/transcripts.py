"""Chat formatting: roles of transcript lines by a hidden Markov model.

A transcript is plain text; its turns may begin with speaker markers of many
styles ("User:", "Q:", "[system]", "Sam>"), or with none. The hidden state of a
line is a role and whether the line begins a turn of it. What is seen of a line:
its marker class, its length, whether it asks, whether a blank line comes before,
whether it is the first. Transition and emission probabilities are counted over
all labelled lines (add-one smoothing), and the most probable states are found
by Viterbi over the whole transcript. Each turn is then rendered in one form:

    <|im_start|>role
    content<|im_end|>

A marker is removed from a turn's first line; "<|" within content becomes
"< |", so that content can't forge turns. Unknown names are told apart by order:
the first name met, the second, and others.

Defined cases: a null transcript has no turns and renders as the empty string;
blank lines belong to the turn before them, and are dropped at its end. A null
role or text trains nothing or is an empty line. A null conv_id is one
conversation of its own. Turns with equal numbers are ordered by role, then
text; repeated rows are repeated turns. With no labelled lines every role is as
likely, and markers decide by ``PRIOR``. Of equally probable states the first in the
order of ``ROLES`` is taken. An empty table gives no rows. Other columns are not used,
whatever their names. Texts of any length are read whole, with any characters in them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

ROLES = ("system", "user", "assistant")
#: State 2 * role begins a turn, 2 * role + 1 goes on with it.
STATES = 2 * len(ROLES)
_MARKER = re.compile(r"^\s{0,8}(?:#{1,4}\s*)?[\[<(*]{0,2}([^\W\d_][\w .-]{0,24}?)[\]>)*]{0,2}\s{0,2}[:>\]]\**(?:\s+|$)")
_WORDS = {
    "user": "user human q question customer you prompt me person client".split(),
    "assistant": "assistant ai bot a answer agent model response gpt chatbot".split(),
    "system": "system instructions instruction note context sys".split(),
}
_CLASS = {w: r for r, ws in _WORDS.items() for w in ws}
MARKERS = ("none", "user", "assistant", "system", "first name", "second name", "other name")
SIZES = (1, 40, 120, 300, 800)
#: Sizes of the features: marker, length, asks, blank before, first line.
FEATURES = (len(MARKERS), len(SIZES) + 1, 2, 2, 2)
#: Occurrences assumed beforehand of a marker at the beginning of its role's turn.
PRIOR = 3.0


def marker_of(line: str) -> tuple[str, str, str] | None:
    """(class or "name", the name, the rest of the line) if it begins with a marker."""
    m = _MARKER.match(line)
    if not m:
        return None
    name = m[1].strip().lower()
    if name in _CLASS:
        return _CLASS[name], name, line[m.end():]
    # a stranger's marker is a capitalised name of one or two words
    return ("name", name, line[m.end():]) if m[1][0].isupper() and len(m[1].split()) <= 2 else None


def observe(lines: list[str]) -> list[tuple[int, ...]]:
    """The features of each line that isn't blank."""
    names: dict[str, int] = {}
    out = []
    blank = False
    for line in lines:
        if not line.strip():
            blank = True
            continue
        m = marker_of(line)
        kind = 0
        if m and m[0] == "name":
            kind = 4 + min(2, names.setdefault(m[1], len(names)))
        elif m:
            kind = MARKERS.index(m[0])
        size = sum(len(line) > s for s in SIZES)
        out.append((kind, size, int(line.rstrip().endswith("?")), int(blank), int(not out)))
        blank = False
    return out


class Model:
    """Log probabilities from counts: start, transitions, and each feature by state."""

    def __init__(self, counts: np.ndarray | None = None):
        counts = np.zeros(width()) if counts is None else counts
        start, move, *seen = split(counts + 1.0)
        for r, role in enumerate(ROLES):
            seen[0][2 * r, MARKERS.index(role)] += PRIOR
        self.start = np.log(start / start.sum())
        self.move = np.log(move / move.sum(axis=1, keepdims=True))
        # nothing goes on with a role that didn't begin
        for r in range(len(ROLES)):
            for s in range(STATES):
                if s // 2 != r:
                    self.move[s, 2 * r + 1] = -1e9
        self.start[1::2] = -1e9
        self.seen = [np.log(f / f.sum(axis=1, keepdims=True)) for f in seen]

    def viterbi(self, seen: list[tuple[int, ...]]) -> list[int]:
        """The most probable states; ties go to the lower state."""
        if not seen:
            return []
        emit = sum(f[:, [o[k] for o in seen]] for k, f in enumerate(self.seen))
        score = self.start + emit[:, 0]
        back = np.zeros((len(seen), STATES), np.int8)
        for t in range(1, len(seen)):
            ways = score[:, None] + self.move
            back[t] = ways.argmax(axis=0)
            score = ways.max(axis=0) + emit[:, t]
        state = int(score.argmax())
        path = [state]
        for t in range(len(seen) - 1, 0, -1):
            state = int(back[t, state])
            path.append(state)
        return path[::-1]


def width() -> int:
    return STATES + STATES * STATES + STATES * sum(FEATURES)


def split(counts: np.ndarray) -> list[np.ndarray]:
    at = STATES + STATES * STATES
    out = [counts[:STATES].copy(), counts[STATES:at].reshape(STATES, STATES).copy()]
    for n in FEATURES:
        out.append(counts[at : at + STATES * n].reshape(STATES, n).copy())
        at += STATES * n
    return out


def count(counts: np.ndarray, states: list[int], seen: list[tuple[int, ...]]) -> None:
    """Adds one transcript; state -1 is unknown."""
    at = STATES
    for t, s in enumerate(states):
        if s < 0:
            continue
        if t == 0:
            counts[s] += 1
        elif states[t - 1] >= 0:
            counts[at + states[t - 1] * STATES + s] += 1
        base = at + STATES * STATES
        for k, n in enumerate(FEATURES):
            counts[base + s * n + seen[t][k]] += 1
            base += STATES * n


def turns(text: str | None, model: Model) -> list[tuple[str, str]]:
    """(role, content) of each turn."""
    lines = (text or "").splitlines()
    path = iter(model.viterbi(observe(lines)))
    out: list[tuple[str, list[str]]] = []
    for line in lines:
        if not line.strip():
            if out:
                out[-1][1].append("")
            continue
        state = next(path)
        if state % 2 == 0 or not out:
            m = marker_of(line)
            out.append((ROLES[state // 2], [m[2] if m else line]))
        else:
            out[-1][1].append(line)
    return [(role, "\n".join(body).strip()) for role, body in out]


def render(found: list[tuple[str, str]]) -> str:
    return "".join(f"<|im_start|>{role}\n{body.replace('<|', '< |')}<|im_end|>\n" for role, body in found)


#: Styles of transcripts: markers of user, assistant and system, and what parts turns.
STYLES = (
    ("User: ", "Assistant: ", "System: ", "\n"),
    ("Human: ", "AI: ", "[System] : ", "\n\n"),
    ("Q: ", "A: ", "Instructions: ", "\n"),
    ("Alex> ", "Sam> ", "Note: ", "\n"),
    ("### User: ", "### Assistant: ", "### System: ", "\n\n"),
    ("", "", "", "\n\n"),
)


def transcribe(conversations: DataFrame) -> DataFrame:
    """conv_id, transcript, starts (of each turn: its role and what is written): turns written out in a style that the conversation's id
    chooses; one turn in eight lacks its marker."""
    h = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES)))
    bare = F.pmod(F.xxhash64("conv_id", "turn", F.lit("bare")), F.lit(8)) == 0
    def pick(k: int) -> Column:
        return F.element_at(F.array(*[F.lit(s[k]) for s in STYLES]), (h + 1).cast("int"))

    role = F.lower(F.trim("role"))
    mark = F.when(bare, F.lit("")).when(role == "user", pick(0)).when(role == "assistant", pick(1)).when(role == "system", pick(2)).otherwise(F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    turn = F.struct(F.col("turn").isNull().alias("last"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text"), F.concat(mark, text).alias("body"), pick(3).alias("gap"))
    grouped = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    written = grouped.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t, i: F.when(i > 0, F.concat(t["gap"], t["body"])).otherwise(t["body"])), "").alias("transcript"),
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["body"].alias("body"))).alias("starts"),
    )
    return written


def true_states(starts: list[dict]) -> list[int]:
    """The states of a transcript's lines that aren't blank, -1 for unknown roles."""
    out = []
    for turn in starts:
        role = turn["role"]
        r = ROLES.index(role) if role in ROLES else None
        for i, _ in enumerate(x for x in (turn["body"] or "").splitlines() if x.strip()):
            out.append(-1 if r is None else 2 * r + (i > 0))
    return out


def _count_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(width())
    for b in batches:
        for text, starts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            seen = observe((text or "").splitlines())
            count(total, true_states(starts or []), seen)  # turns are parted by line breaks: lines are the same
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], names=["slot", "n"])


def fit(labelled: DataFrame) -> Model:
    """The model counted over ``transcript, starts`` of all rows."""
    counts = np.zeros(width())
    for r in labelled.select("transcript", "starts").mapInArrow(_count_all, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        counts[r["slot"]] = r["n"]
    return Model(counts)


def _parse(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [turns(t, model) for t in part.column(1).to_pylist()]
                cols = [
                    part.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array([[r for r, _ in f] for f in found], pa.list_(pa.string())),
                    pa.array([render(f) for f in found], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["conv_id", "n_turns", "roles", "rendered"])

    return run


def parse(transcripts: DataFrame, model: Model) -> DataFrame:
    """conv_id, n_turns, roles, rendered of ``conv_id, transcript``."""
    plain = transcripts.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("transcript").cast("string").alias("transcript"))
    return plain.mapInArrow(_parse(transcripts.sparkSession.sparkContext.broadcast(model)), "conv_id long, n_turns long, roles array<string>, rendered string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as transcripts, parsed without their roles."""
    written = staged(transcribe(table(spark, sf_dir, "conversations")))
    return parse(written, fit(written))
