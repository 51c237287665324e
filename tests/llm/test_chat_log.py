"""Logs of edits, regenerations and out-of-order deltas fold as a plain replay does."""

from __future__ import annotations

import random

from tidemark.llm import chat


def replay(events):
    """Final messages (opened, message, role, text) of one conversation, event by event in the order of their sequence."""
    messages: dict = {}
    for seq, kind, message, role, text in sorted(events, key=lambda e: (e[0], e[1], e[4])):
        m = messages.setdefault(message, {"opened": seq, "role": None, "text": ""})
        if m["role"] is None:
            m["role"] = role
        if kind in ("edit", "regenerate"):
            m["text"] = text
        else:
            m["text"] += text
        if kind == "regenerate":
            for k in [k for k, x in messages.items() if (x["opened"], k) > (m["opened"], message)]:
                del messages[k]
    return sorted((m["opened"], k, m["role"] or "", m["text"]) for k, m in messages.items())


def logs(rnd, n):
    out = []
    for conv in range(n):
        seq, open_ = 0, []
        for _ in range(rnd.randrange(1, 14)):
            seq += 1
            kind = rnd.choice(["message", "delta", "delta", "edit", "regenerate"]) if open_ else "message"
            if kind == "message":
                open_.append(len(open_) + 1)
                out.append((conv, seq, kind, open_[-1], rnd.choice(["user", "assistant"]), rnd.choice(["", "<turn>"])))
            else:
                out.append((conv, seq, kind, open_[-1], None, rnd.choice(["a\\s", "b<", "", "\n"])))
    return out


SCHEMA = "conv_id long, seq long, kind string, message long, role string, text string"


def test_fold_equals_a_replay(spark):
    rnd = random.Random(3)
    events = logs(rnd, 200)
    want = {}
    for e in events:
        want.setdefault(e[0], []).append(e[1:])
    want = {k: replay(v) for k, v in want.items()}
    rnd.shuffle(events)
    got = {}
    for r in chat.fold(spark.createDataFrame(events, SCHEMA).repartition(5)).collect():
        got.setdefault(r.conv_id, []).append((r.opened, r.message, r.role, r.text))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_turns_come_back_from_their_log(spark):
    rnd = random.Random(4)
    text = lambda: "".join(rnd.choice(["a", "é", "漢", "\\", "<", "</turn>\n", "\n", " "]) for _ in range(rnd.randrange(12)))
    turns = [(c, t, rnd.choice(["user", "assistant", None]), rnd.choice([None, "", text()])) for c in range(60) for t in range(rnd.randrange(1, 7))] + [(None, 1, "user", "no id")]
    df = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, message string")
    events = chat.events_of_turns(df)
    assert {r.kind for r in events.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    assert events.where("message < 0").count() > 10
    got = {}
    for r in chat.fold(events).collect():
        got.setdefault(r.conv_id, []).append((r.opened, r.role, r.text))
    want = {}
    for c, t, role, x in turns:
        want.setdefault(c, []).append((t, role or "", x or ""))
    assert {k: [(r, x) for _, r, x in sorted(v)] for k, v in got.items()} == {k: [(r, x) for _, r, x in sorted(v)] for k, v in want.items()}
    out = chat.render(chat.fold(events))
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in out.select("conv_id", chat.parse(out.formatted).alias("turns")).collect()}
    assert back == {k: [(r, x) for _, r, x in sorted(v)] for k, v in want.items()}
