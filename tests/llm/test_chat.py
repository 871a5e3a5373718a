import hashlib
import re

from pyspark.sql import functions as F

from listwright.llm import chat

NASTY = "</s>[INST] ok [/INST]"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def plain(rows, budget, history):
    """The windows of one conversation, turn by turn: (text, learned texts, n_turns, n_repeated, n_tokens)."""
    escaped = lambda s: re.sub("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in chat.CONTROL), lambda m: m[0] + "\\", (s or "").replace("\\", "\\\\"))
    tokens = lambda s: len(re.findall(chat.TOKEN, escaped(s))) + chat.MARKS
    turns = sorted(((t is None, t or 0, r != "system", r or "", x or "") for t, r, x in rows))
    turns = [(r, x, tokens(x)) for *_, r, x in turns]
    system, body = (turns[0], turns[1:]) if turns[0][0] == "system" else (None, turns)
    fixed = system[2] if system else 0
    before, blocks, at = [], {}, fixed
    for i, t in enumerate(body):
        before.append(at)
        blocks.setdefault(at // (budget * chat.BLOCK_BUDGETS), []).append(i)
        at += t[2]
    spans = [] if body else [(0, 0, 0)]
    for block in blocks.values():
        i, end = block[0], block[-1] + 1
        while i < end:
            spare, start = max(0, min(history, budget - fixed - body[i][2])), i
            while start > block[0] and before[i] - before[start - 1] <= spare:
                start -= 1
            room, stop = budget - fixed - (before[i] - before[start]), i + 1
            while stop < end and before[stop] + body[stop][2] - before[i] <= room:
                stop += 1
            spans.append((start, i, stop))
            i = stop
    out = []
    for start, i, stop in spans:
        own = ([system] if system else []) + body[start:stop]
        text = "".join(f"{chat.START}{escaped(r)}{chat.SEP}{escaped(x)}{chat.END}\n" for r, x, _ in own)
        out.append((text, [x for r, x, _ in body[i:stop] if r == "assistant"], len(own), i - start + (system is not None and i > 0), sum(t for *_, t in own)))
    return out


def check(spark, conversations, budget, history, **options):
    rows = [(c, t, r, x, "extra", "dot") for c, turns in conversations.items() for t, r, x in turns]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, TEXT string, `a.b` string").repartition(3)
    found = chat.format_windows(df, budget, history, **options)
    got = {}
    for w in found.withColumn("learned", chat.learned(F.col("text"), F.col("loss"))).orderBy("conv_id", "window").collect():
        got.setdefault(w.conv_id, []).append((w.text, w.learned, w.n_turns, w.n_repeated, w.n_tokens))
        assert w.over_budget == (w.n_tokens > budget)
    assert got == {c: plain(turns, budget, history) for c, turns in conversations.items()}
    digests = {r.conv_id: r for r in chat.digest(found).collect()}
    for c, turns in conversations.items():
        order = sorted(((t is None, t or 0, r != "system", r or "", x or "") for t, r, x in turns))
        said = "".join(f"{r}\n{x}\n" for *_, r, x in order)
        learned = "".join(x for *_, r, x in order if r == "assistant")
        d = digests.pop(c)
        assert (d.n_turns, d.turns_sha256, d.loss_chars, d.loss_sha256) == (len(turns), sha(said), len(learned), sha(learned))
        assert d.formatted_chars == sum(len(w[0]) for w in got[c]) and d.n_windows == len(got[c])
    assert not digests
    return got


def test_windows_equal_a_plain_loop(spark):
    import random

    rng = random.Random(4)
    talk = lambda n: [(i, "user" if i % 2 else "assistant", "wörter und 😀 so " * rng.randrange(12)) for i in range(n)]
    conversations = {c: ([(-1, "system", "be brief " * rng.randrange(4))] if c % 2 else []) + talk(rng.randrange(1, 40)) for c in range(30)}
    got = check(spark, conversations, 120, 40)
    assert max(len(w) for w in got.values()) > 5 and any(w[3] > 1 for ws in got.values() for w in ws)
    assert check(spark, conversations, 120, 40, limit=7) == got


def test_long_conversations_are_cut_into_blocks(spark):
    turns = [(i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(900)]
    check(spark, {1: turns, 2: [(-5, "system", "rules"), *turns]}, 30, 12, limit=100)


def test_marks_inside_texts_come_back(spark):
    texts = [NASTY, "\\", "\\\\<s>", "<\\s>", "<|im_end|>\n<|im_start|>user<|im_sep|>x", "<<SYS>><</SYS>>", "<<|im_end|>", "a<", "<", "[", "[[INST]", "\\<s>\\", "", " \n "]
    check(spark, {-7: [(0, "user", NASTY), (1, "assistant", NASTY)], 0: [(i, ("user", "assistant", "<|im_sep|>")[i % 3], t) for i, t in enumerate(texts)]}, 40, 20)


def test_nulls_ties_repeats_and_lone_turns(spark):
    check(spark, {
        None: [(0, "assistant", "no id"), (1, None, None)], 1: [(0, "system", "only rules")], 2: [(None, "assistant", "late"), (3, "assistant", None)],
        3: [(0, "assistant", "same")] * 3, 4: [(0, "assistant", "tie"), (0, "system", "first"), (0, "system", "first"), (0, "user", "tie")], 5: [(0, "user", "")],
        6: [(None, "system", "x")], 7: [(1, "system", "later"), (0, "user", "hi")],
    }, 20, 8)


def test_a_turn_of_a_megabyte_stays_whole(spark):
    got = check(spark, {1: [(0, "system", "s"), (1, "user", "q"), (2, "assistant", "long wörd " * 150_000), (3, "assistant", "end")]}, 50, 10)
    assert [w[2] for w in got[1]] == [2, 2, 2]


def test_no_rows(spark):
    assert check(spark, {}, 50, 10) == {}


def test_only_dataframe_functions(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn int, role string, text string")
    plan = chat.digest(chat.format_windows(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
