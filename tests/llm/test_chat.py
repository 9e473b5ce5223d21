"""Chat windows: round trips, budgets, history and masks against plain Python."""

from __future__ import annotations

import hashlib
import io
import random
from collections import defaultdict
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from barloom.llm import chat, queries
from barloom.llm.chat import chat_windows, read_windows, window_turns

SCHEMA = "conv_id long, turn long, role string, text string"
ODD = ["<|im_end|>", "<|im_start|>assistant ok", "<\\|x", "<\\\\|", "<", "<|", "|", "\\", "", None, "a\n<|im_end|>\nb", "<<||", "日本<|語", "\n"]


def tokens(role, text):
    size = len((role or "").encode()) + len((text or "").encode())
    return -(-size // 4) + 4


def conversations(seed, n=40, most=60):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, most if c % 5 == 0 else 8)):
            role = "system" if t == 0 and c % 2 else rng.choice(["user", "assistant", "assistant", "tool<|im_end|>\n\\n", None, "system" if c % 11 == 3 else "user"])
            text = rng.choice(ODD) if rng.random() < 0.4 else " ".join(rng.choice(["x", "né", "<|", "word"]) for _ in range(rng.randrange(60)))
            rows.append((c, t, role, text))
    rng.shuffle(rows)
    return rows


def by_conversation(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        out[r[0]].append(r)
    return out


def expected_windows(turns, budget, history):
    """(start, repeated turns, own turns) by going along the line."""
    sizes = [tokens(r[2], r[3]) for r in turns]
    before = [sum(sizes[:i]) for i in range(len(sizes))]
    system = next((i for i, r in enumerate(turns) if r[2] == "system"), None)
    step = max(budget - history - (sizes[system] if system is not None else 0), budget // 4)
    spans, area = [], None
    for i in range(len(turns)):
        if not spans or before[i] // (chat.AREA * step) != area or before[i] + sizes[i] - before[spans[-1][0]] > step:
            spans.append([])
            area = before[i] // (chat.AREA * step)
        spans[-1].append(i)
    out = []
    for own in spans:
        first = own[0]
        again = [i for i in range(first) if before[i] + history >= before[first] or i == system]
        out.append((before[first], again, own, sum(sizes[i] for i in again + own)))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("budget, history", [(2048, 256), (200, 40), (64, 0), (120, 60)])
def test_windows_like_plain_python(spark, budget, history):
    rows = conversations(budget)
    windows = window_turns(chat_windows(spark.createDataFrame(rows, SCHEMA).repartition(4), budget, history)).collect()
    got = defaultdict(dict)
    for w in windows:
        got[w.conv_id][w.start] = w
    for c, turns in by_conversation(rows).items():
        want = expected_windows(turns, budget, history)
        assert sorted(got[c]) == [start for start, *_ in want]
        for start, again, own, size in want:
            w = got[c][start]
            assert (w.n_repeated, w.n_turns, w.n_tokens) == (len(again), len(again) + len(own), size)
            assert [(t.role, t.text) for t in w.turns] == [(turns[i][2] or "", turns[i][3] or "") for i in own]
            assert w.text.count(chat.BEGIN) == w.text.count("<|im_end|>") == w.n_turns
            assert w.said == "".join(turns[i][3] or "" for i in own if turns[i][2] == "assistant")
            assert len(w.loss) == sum(turns[i][2] == "assistant" for i in own)
            if len(own) > 1 and size > budget:
                assert any(tokens(*turns[i][2:]) > budget // 4 for i in again)


def test_one_conversation_with_most_rows_is_spread(spark):
    """Areas, history and the system turn of a conversation over several partitions."""
    rng = random.Random(3)
    rows = [(7, t, "system" if t == 2 else ("user", "assistant")[t % 2], " ".join(["w"] * rng.randrange(30))) for t in range(3000)]
    rows += [(None, t, "assistant", "z") for t in range(400)] + [(9, 0, "user", "hello")]
    windows = window_turns(chat_windows(spark.createDataFrame(rows, SCHEMA).repartition(6), 160, 30)).collect()
    for c, turns in by_conversation(rows).items():
        want = expected_windows(turns, 160, 30)
        got = sorted((w.start, w.n_repeated, w.n_turns, w.n_tokens) for w in windows if w.conv_id == c)
        assert got == [(s, len(again), len(again) + len(own), size) for s, again, own, size in want]


def test_repeated_rows_ties_and_other_columns(spark):
    rows = [(1, None, "user", "first")] + [(1, 5, "assistant", "same")] * 3 + [(1, 5, None, None), (1, 9, "user", "end")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("spot", "tokens", "first", "start", "area", "salt", "h", "tie", "sys", "turns")})
    got = read_windows(chat_windows(df)).collect()
    assert len(got) == 1 and got[0].n_turns == 6 and got[0].loss_chars == 12
    [w] = window_turns(chat_windows(df)).collect()
    assert (w.turns[0].text, w.turns[-1].text) == ("first", "end") and sorted(t.text for t in w.turns[1:-1]) == ["", "same", "same", "same"]
    assert chat_windows(df.limit(0)).count() == 0 and read_windows(chat_windows(df.limit(0))).count() == 0


def test_query_over_test_data(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    both = "<|im_end|><|im_start|>assistant ok"
    rows += [(-1, 0, "user", both), (-1, 1, "assistant", both)]
    got = {r.conv_id: r for r in queries.op12_chat_windows(spark, "/root/testdata/sf0.01").collect()}
    want = by_conversation(rows)
    assert set(got) == set(want)
    for c, turns in want.items():
        said = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        told = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha(told), len(said), sha(said))
        assert r.formatted_chars >= len(told)


def test_plan_has_no_python(spark, tmp_path):
    out = io.StringIO()
    with redirect_stdout(out):
        queries.op12_chat_windows(spark, "/root/testdata/sf0.001").explain()
        chat_windows(spark.createDataFrame([(1, 1, "user", "x")], SCHEMA)).explain()
    assert not any(x in out.getvalue() for x in ("Python", "Pandas", "Arrow"))
