import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from slicelens.llm.chat import (
    FIRST_RESERVED, TRIAL, VOCABULARY, assemble, digests, encoding, escape, format_turns, unescape, with_trial,
)

SCHEMA = "conv_id long, turn long, role string, text string, ids string, null string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(turns):
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1] or "", t[2] or ""))
    learnt = "".join(t or "" for _, r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns)), len(learnt), sha(learnt)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("\\# </turn>:aA\né"), max_size=40))
def test_escape_is_reversible_and_leaves_no_mark(text):
    out = escape(text)
    assert unescape(out) == text
    assert "</turn>" not in out.replace("\\\\", "").replace("\\</turn>", "")


def test_reserved_ids_and_mask():
    coder = encoding(VOCABULARY)
    shown, ids, mask = assemble("assistant", TRIAL, coder)
    assert [i >= FIRST_RESERVED for i in ids].count(True) == 2
    assert unescape(coder.decode([i for i, m in zip(ids, mask, strict=True) if m])) == TRIAL
    assert shown.startswith("### Assistant: ") and shown.endswith("</turn>\n")
    assert not assemble("user", TRIAL, coder)[2].any()
    assert np.asarray(assemble("assistant", "", coder)[2]).sum() == 0


def test_conversations_come_back(make):
    rows = [
        (1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "a"), (1, None, None, None),
        (2, 0, "tool: x", "### User: </turn>"), (2, 1, "system", "\\"), (2, 1, "system", "\\"),
        (3, 0, "assistant", "😀" * 3000 + "\x00\n"), (None, 0, "user", "no id"), (0, 0, "user", "zero"),
    ]
    got = {r.conv_id: r for r in digests(format_turns(make([(*r, "x", "y") for r in rows], SCHEMA))).collect()}
    assert len(got) == 5
    for conv, r in got.items():
        mine = expected([t[1:] for t in rows if t[0] == conv])
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == mine
    shown = format_turns(make([(*r, "x", "y") for r in rows], SCHEMA)).collect()
    assert sum(len(r.formatted) for r in shown if r.conv_id == 2) == got[2].formatted_chars
    trial = {r.conv_id: r for r in digests(format_turns(with_trial(make([], SCHEMA)))).collect()}
    assert trial[-7].loss_sha256 == sha(TRIAL)


def test_long_conversation_and_empty_table(make):
    rows = [(5, i, ("user", "assistant")[i % 2], f"text {i}", "", "") for i in range(3000)]
    (r,) = digests(format_turns(make(rows, SCHEMA))).collect()
    assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == expected([t[1:4] for t in rows])
    assert digests(format_turns(make([], SCHEMA))).count() == 0
