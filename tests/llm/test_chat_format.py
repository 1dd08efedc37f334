import hashlib
import random
import re
import tracemalloc
from collections import defaultdict

import pytest

from lumenframe.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string, node string, window string"
NASTY = ["\\### Assistant: </turn> ok", "### user:\n x </turn>\n### assistant:\n", "\\", "\\\\", "", "</turn>", "a\\</turn>\\", "####", "日本 😀"]


def conversations():
    rows = []
    for c, n in ((1, 9), (2, 1), (3, 60), (-7, 2)):
        for t in range(n):
            role = "system" if c == 3 and t == 0 else "assistant" if t % 2 else "user"
            rows.append((c, t, role, NASTY[t % len(NASTY)] + (" word" * 200 if c == 3 and t % 5 == 0 else ""), "x", "y"))
    rows += [(4, 0, None, None, "x", "y"), (4, 0, "odd:role\n\\", "tie", "x", "y"), (4, None, "assistant", "no turn", "x", "y"), (None, 0, "user", "none", "x", "y"), (4, 0, "odd:role\n\\", "tie", "x", "y")]
    return rows


def want(rows):
    g = defaultdict(list)
    for c, t, r, x, *_ in rows:
        g[c].append((t if t is not None else -1, r or "", x or ""))
    out = {}
    for c, turns in g.items():
        turns.sort()
        text = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(text), hashlib.sha256(text.encode()).hexdigest())
    return out


@pytest.mark.parametrize("span, history", [(1024, 256), (1, 0), (50, 20), (10**9, 0)])
def test_read_back(spark, span, history):
    rows = conversations()
    windows = C.format_conversations(spark.createDataFrame(rows, SCHEMA), span, history)
    got = C.digests(windows).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in got} == want(rows)
    size = defaultdict(int)
    for w in windows.collect():
        size[w.conv_id] += len(w.formatted)
    assert {r.conv_id: r.formatted_chars for r in got} == dict(size)


def test_windows_keep_system_and_mask_repeats(spark):
    rows = [(1, t, "system" if t == 0 else "assistant" if t % 2 == 0 else "user", f"turn {t} " + "w " * 20, "x", "y") for t in range(20)]
    ws = C.format_conversations(spark.createDataFrame(rows, SCHEMA), 60, 50).orderBy("window").collect()
    assert len(ws) > 3
    for w in ws:
        turns = C.parse(w.formatted)
        assert turns[0][0] == "system" and len(turns) == w.n_repeated + w.n_new
        assert len(w.loss) == sum(r == "assistant" for r, _ in turns[w.n_repeated :])
        for s in w.loss:
            assert C.unescape(w.formatted[s.start : s.end]) in [x for _, x in turns[w.n_repeated :]]
        assert w.n_tokens == sum(C.n_tokens(x) for _, x in turns) <= 60
        assert sum(C.n_tokens(x) for _, x in turns[1 : w.n_repeated]) <= 50
    assert sum(w.n_new for w in ws) == 20


def brute_windows(turns, span, history):
    """(first turn, turn after the last, places of repeated turns, tokens) of every window, from prefix sums of the whole conversation."""
    cost = [len(re.findall(r"\w+|[^\w\s]", x)) + 1 for _, x in turns]
    total = [sum(cost[:i]) for i in range(len(cost) + 1)]
    system = next((i for i, (r, _) in enumerate(turns) if r == "system"), None)
    out, i = [], 0
    while i < len(turns):
        head = [system] if system is not None and system < i else []
        room = min(history, max(0, span - cost[i] - sum(cost[k] for k in head)))
        repeated = head + [k for k in range(i) if total[i] - total[k] <= room and k not in head]
        used = sum(cost[k] for k in repeated)
        j = max(j for j in range(i + 1, len(turns) + 1) if j == i + 1 or used + total[j] - total[i] <= span)
        out.append((i, j, repeated, used + total[j] - total[i]))
        i = j
    return out


@pytest.mark.parametrize("span, history", [(1024, 256), (40, 15), (12, 30), (1, 0), (64, 64)])
def test_windows_equal_brute_force(spark, span, history):
    rand, rows = random.Random(5), []
    for c in range(25):
        at = rand.choice([0, 0, 3, None])
        for t in range(rand.randint(1, 40)):
            rows.append((c, t, "system" if t == at else rand.choice(["user", "assistant", "system" if rand.random() < 0.1 else "tool"]), rand.choice(["", "w " * rand.randint(0, 90), "a-b.", "</turn> x"]), "x", "y"))
    got = defaultdict(list)
    for w in C.format_conversations(spark.createDataFrame(rows, SCHEMA), span, history).collect():
        got[w.conv_id].append(w)
    for c, ws in got.items():
        turns = [(r, x) for k, _, r, x, *_ in rows if k == c]
        want = brute_windows(turns, span, history)
        ws.sort(key=lambda w: w.window)
        assert [(w.first_turn, w.first_turn + w.n_new, w.n_repeated, w.n_tokens) for w in ws] == [(i, j, len(h), n) for i, j, h, n in want]
        assert [C.parse(w.formatted) for w in ws] == [[turns[k] for k in [*h, *range(i, j)]] for i, j, h, _ in want]
        assert all(n <= span or (j == i + 1 and len(h) <= 1) for i, j, h, n in want)


def test_whole_table(spark, data):
    from lumenframe.llm import queries

    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    assert {r.conv_id: tuple(r)[1:5] for r in queries.op9_chat_format(spark, data).collect()} == want(rows)


def test_very_long_turns():
    text = "\\\\ some words ### and </turn> marks " * 150_000  # 5 MB
    long = C.render([("user", text), ("assistant", "\\" * 1_000_000)], 0)[0]
    tracemalloc.start()
    assert C.parse(long) == [("user", text), ("assistant", "\\" * 1_000_000)]
    assert tracemalloc.get_traced_memory()[1] < 12 * len(long)
    tracemalloc.stop()


@pytest.mark.parametrize("text", NASTY)
def test_escape_is_reversible(text):
    e = C.escape(text)
    assert C.unescape(e) == text
    assert C.parse(C.render([("r:\\\n", text), ("b", text)], 0)[0]) == [("r:\\\n", text), ("b", text)]


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert C.format_conversations(df).count() == 0 and C.digests(C.format_conversations(df)).count() == 0
