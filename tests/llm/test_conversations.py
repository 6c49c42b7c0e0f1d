"""Preference formatting against brute force."""

import random

from quarrykit.llm import preference

TURNS = "conv_id long, turn long, role string, text string"


def render(turns):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)


def trained(text, spans):
    return [text[s.start : s.end] for s in spans]


def brute(chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    return n, render(chosen[:n]), render(chosen[n:]), render(rejected[n:])


def test_pairs_are_split_at_their_common_prefix(spark):
    rng = random.Random(1)
    rows = []
    for i in range(200):
        talk = lambda: [(("user", "assistant")[k % 2], rng.choice(["a", "b", "", "é€", "long " * 9])) for k in range(rng.randrange(0, 6))]
        shared = talk()
        rows.append((i, shared + talk(), shared + talk()))
    turns = "array<struct<role:string,text:string>>"
    got = {r.i: r for r in preference.preference_format(spark.createDataFrame(rows, f"i long, chosen {turns}, rejected {turns}")).collect()}
    for i, chosen, rejected in rows:
        r = got[i]
        assert (r.shared_turns, r.prompt, r.chosen_completion, r.rejected_completion) == brute(chosen, rejected)
        for turns_, text, spans in ((chosen, r.chosen_completion, r.chosen_spans), (rejected, r.rejected_completion, r.rejected_spans)):
            assert trained(text, spans) == [f"{t}<|im_end|>\n" for role, t in turns_[r.shared_turns :] if role == "assistant"]


def test_conversations_that_open_alike_are_paired(frame):
    rng = random.Random(2)
    talks, rows = {}, []
    for i in range(300):
        opening = "the same" if i < 150 else f"own {i // 2}" if i < 260 else f"alone {i}"
        talks[i] = [("user", opening)] + [(("user", "assistant")[(k + 1) % 2], f"{rng.random()}"[: rng.randrange(2, 9)]) for k in range(rng.randrange(0, 5))]
        rows += [(i, k, r, t) for k, (r, t) in enumerate(talks[i])]
    got = preference.preferences(frame(TURNS, rows + rows[:3])).collect()  # equal rows count once
    groups = {}
    for i in sorted(talks):
        groups.setdefault(talks[i][0], []).append(i)
    pairs = {frozenset(p) for g in groups.values() for p in zip(g, g[1:], strict=False)}
    assert {frozenset((r.chosen_id, r.rejected_id)) for r in got if r.rejected_id is not None} == pairs
    assert len(got) == len(talks)
    told = lambda i: sum(len(t) for r, t in talks[i] if r == "assistant")
    for r in got:
        if r.rejected_id is None:
            last = max([k for k, (role, _) in enumerate(talks[r.chosen_id]) if role == "assistant"], default=len(talks[r.chosen_id]))
            want = brute(talks[r.chosen_id], talks[r.chosen_id][:last])
        else:
            assert (told(r.chosen_id), -r.chosen_id) >= (told(r.rejected_id), -r.rejected_id)
            want = brute(talks[r.chosen_id], talks[r.rejected_id])
        assert (r.shared_turns, r.prompt, r.chosen_completion, r.rejected_completion) == want


def test_odd_turns(frame):
    rows = [(1, 1, "assistant", None), (1, 0, None, "hi"), (1, None, "system", "first"), (None, 0, "user", "nobody"), (None, 0, "user", "nobody else"), (2, 0, "user", "x" * 100_000)]
    got = {r.chosen_id: r for r in preference.preferences(frame(TURNS, rows)).collect()}
    assert got[1].prompt == render([("system", "first"), ("user", "hi")]) and got[1].chosen_completion == render([("assistant", "")])
    assert sum(r.chosen_id is None for r in preference.preferences(frame(TURNS, rows)).collect()) == 2
    assert set(got) == {1, 2, None} and len(got[2].prompt) > 100_000
    assert preference.preferences(frame(TURNS, [])).collect() == []


def test_formatting_stays_in_the_jvm(spark, sf):
    plan = preference.preferences(spark.read.parquet(f"{sf}/conversations.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
