"""Chat formatting on token level.

Each text is encoded by itself and reserved ids are spliced between, so no
text can produce a template mark. Control strings inside texts are escaped, so
the rendered string can be read back as well. The loss mask is the running sum
of a +1 where an assistant text begins and a -1 where it ends.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicelens.llm.common import read
from slicelens.llm.registry import query

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
FIRST_RESERVED = 50257
ROLES = ("user", "assistant", "system")
#: Reserved ids in order: one mark a known role, the two around any other role's name, the turn's end.
MARKS = (*[f"### {r.capitalize()}: " for r in ROLES], "### Role ", ": ", "</turn>\n")
OTHER, NAME_END, TURN_END = (FIRST_RESERVED + len(ROLES) + i for i in range(3))
CONTROL = ("### ", "</turn>")
FORMATTED = (
    "conv_id bigint, turn bigint, role string, text string, formatted string, "
    "ids array<int>, loss array<boolean>"
)
DIGEST = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
    "loss_sha256 string, formatted_chars bigint"
)


def escape(text: str, name: bool = False) -> str:
    r"""Double every ``\`` and put one before each control string."""
    text = text.replace("\\", "\\\\")
    for control in CONTROL + ((": ",) if name else ()):
        text = text.replace(control, "\\" + control)
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


@functools.lru_cache(maxsize=2)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def assemble(role: str, text: str, coder) -> tuple[str, list[int], np.ndarray]:
    """Rendered string, token ids and loss mask of one turn."""
    body = coder.encode_ordinary(escape(text))
    if role in ROLES:
        mark = ROLES.index(role)
        start, head = MARKS[mark], [FIRST_RESERVED + mark]
    else:
        name = escape(role, name=True)
        start = MARKS[OTHER - FIRST_RESERVED] + name + MARKS[NAME_END - FIRST_RESERVED]
        head = [OTHER, *coder.encode_ordinary(name), NAME_END]
    ids = [*head, *body, TURN_END]
    steps = np.zeros(len(ids) + 1, dtype=np.int8)
    if role == "assistant":
        steps[len(head)] += 1
        steps[len(head) + len(body)] -= 1
    shown = start + escape(text) + MARKS[TURN_END - FIRST_RESERVED]
    return shown, ids, np.cumsum(steps[:-1]).astype(bool)


def format_turns(turns: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row a turn: its rendered string, token ids and loss mask.

    Needs ``conv_id, turn, role, text``; other columns are dropped. Null texts
    and roles count as empty. A conversation is its rows by ``turn`` (null
    first; ties by role, then text), so the pieces of a conversation in that
    order are its whole sequence. Turns are encoded independently, so one huge
    conversation is spread over all tasks.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoding(vocabulary)
        for batch in batches:
            made = [assemble(r, t, coder) for r, t in zip(batch.role, batch.text, strict=True)]
            yield batch.assign(
                formatted=[m[0] for m in made],
                ids=[m[1] for m in made],
                loss=[m[2] for m in made],
            )

    plain = turns.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    return plain.mapInPandas(encode, FORMATTED)


class Reader:
    """Reads token ids and masks of one conversation back, turn by turn."""

    def __init__(self, coder):
        self.coder = coder
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def _text(self, ids: np.ndarray) -> str:
        return self.coder.decode_bytes(ids.tolist()).decode("utf-8")

    def add(self, ids: np.ndarray, mask: np.ndarray) -> None:
        marks = np.flatnonzero(ids >= FIRST_RESERVED)
        if ids[0] == OTHER:
            name = self._text(ids[marks[0] + 1 : marks[1]])
            role, at, marks = unescape(name), marks[1], marks[1:]
            self.chars += len(name) + len(MARKS[NAME_END - FIRST_RESERVED])
        else:
            role, at = ROLES[ids[0] - FIRST_RESERVED], marks[0]
        body = self._text(ids[at + 1 : marks[1]])
        self.chars += len(body) + len(MARKS[ids[0] - FIRST_RESERVED]) + len(MARKS[-1])
        self.turns.update(f"{role}\n{unescape(body)}\n".encode())
        learnt = unescape(self._text(ids[mask]))
        self.loss.update(learnt.encode())
        self.loss_chars += len(learnt)
        self.n_turns += 1

    def row(self, conv_id) -> tuple:
        return (conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars,
                self.loss.hexdigest(), self.chars)


def digests(formatted: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """What the token ids and masks of each conversation say, as counts and hashes.

    A digest of text is sequential, so a conversation is one run of rows in one
    task; rows stream by and only the hash state is kept, whatever its length.
    """

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoding(vocabulary)
        columns = [c.split()[0] for c in DIGEST.split(", ")]
        now, reader = None, None
        for batch in batches:
            done = []
            # A null id arrives as NaN or None; -1 in `null` marks it.
            for conv, null, ids, loss in zip(
                batch.conv_id, batch.null, batch.ids, batch.loss, strict=True
            ):
                key = None if null else int(conv)
                if reader is None or key != now:
                    if reader is not None:
                        done.append(reader.row(now))
                    now, reader = key, Reader(coder)
                reader.add(np.asarray(ids), np.asarray(loss, dtype=bool))
            if done:
                yield _frame(done, columns)
        if reader is not None:
            yield _frame([reader.row(now)], columns)

    ordered = (
        formatted.repartition(F.col("conv_id"))
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select(F.coalesce("conv_id", F.lit(0)).alias("conv_id"),
                F.col("conv_id").isNull().alias("null"), "ids", "loss")
    )
    return ordered.mapInPandas(collect, DIGEST)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=columns)
    return frame.astype({"conv_id": "Int64"})


TRIAL = r"\### Assistant: </turn> ok"


def with_trial(conversations: DataFrame) -> DataFrame:
    """The table plus conversation -7, whose texts hold the template's own marks."""
    extra = conversations.sparkSession.createDataFrame(
        [(-7, 0, "user", TRIAL), (-7, 1, "assistant", TRIAL)],
        "conv_id bigint, turn bigint, role string, text string",
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)


def _escaped(column: str) -> str:
    for old in ("\\", *CONTROL):
        column = f"replace({column}, '{old}', '\\{old}')"
    return column


_OVERHEAD = " ".join(f"WHEN '{r}' THEN {len(m)}" for r, m in zip(ROLES, MARKS, strict=False))
SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{TRIAL}'), (-7, 1, 'assistant', '{TRIAL}')),
loss AS (
  SELECT conv_id, coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text)
         FILTER (role = 'assistant'), '') AS learnt FROM turns GROUP BY conv_id)
SELECT t.conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text))
    AS turns_sha256,
  CAST(length(any_value(learnt)) AS BIGINT) AS loss_chars, sha256(any_value(learnt)) AS loss_sha256,
  CAST(sum(length({_escaped("text")}) + {len(MARKS[-1])} + CASE role {_OVERHEAD}
    ELSE {len(MARKS[len(ROLES)]) + 2} + length(replace({_escaped("role")}, ': ', '\: ')) END)
    AS BIGINT) AS formatted_chars
FROM turns t JOIN loss l ON t.conv_id IS NOT DISTINCT FROM l.conv_id GROUP BY t.conv_id
"""


@query("op4_chat_formatting", SQL)
def op4_chat_formatting(spark, folder):
    """Every conversation, formatted and read back."""
    return digests(format_turns(with_trial(read(spark, folder, "conversations"))))
