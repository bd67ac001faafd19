"""Chat formatting against a list that is edited event by event, and the round trip of any text."""

import random

from pyspark.sql import functions as F

from relspark.llm import chat

LOG = "conv_id long, seq long, kind string, message long, role string, text string"
PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "\\", "<\\/s>", "[\\\\INST]", "<", "[", "]", "é", "\n", "a $1 b", "", "𝄞", "s>", "/INST]"]


def app(r, conv, steps):
    """A chat as an application would lead it: its log, and the messages that are left."""
    log, live, new, seq = [], [], 0, 0
    for _ in range(steps):
        what = r.choice(["new", "new", "delta", "edit", "again"])
        text = "".join(r.choice(PIECES) for _ in range(r.randrange(4)))
        if what == "new" or not live:
            role = r.choice(["user", "assistant", "system", "", "[/ROLE]x", None])
            live.append([new, role or "", text])
            log.append((conv, seq, chat.DELTA, new, role, text))
            new += 1
        elif what == "delta":
            m = r.choice(live)
            m[2] += text
            log.append((conv, seq, chat.DELTA, m[0], None, text))
        elif what == "edit":
            m = r.choice(live)
            m[2] = text
            log.append((conv, seq, chat.EDIT, m[0], None, text))
        else:
            i = r.randrange(len(live))
            live = live[: i + 1]
            live[i][2] = text
            log.append((conv, seq, chat.REGENERATE, live[i][0], None, text))
        seq += r.randrange(1, 3)
    # a role that no event names first is empty, but later events name none
    return log, [(role, text) for _, role, text in live]


def test_fold_render_and_read_back(spark):
    r = random.Random(5)
    want, log = {}, []
    for conv in [None, *range(40)]:
        events, left = app(r, conv, r.choice([1, 3, 20, 60]))
        log += events
        want[conv] = left
    r.shuffle(log)
    made = chat.format_log(spark.createDataFrame(log, LOG).repartition(5)).withColumn("turns", chat.read_back(F.col("formatted")))
    rows = made.withColumn("loss", chat.loss_texts(F.col("turns"), F.col("spans"))).collect()
    assert {x.conv_id: [(t.role, t.text) for t in x.turns] for x in rows} == want
    for x in rows:
        assert [t.body for t in x.turns] == [x.formatted[s.start : s.end] for s in x.spans]
        assert x.loss == [t for role, t in want[x.conv_id] if role == "assistant"]
        for t in x.turns:
            assert not any(c in t.body for c in ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]"))


def test_taken_back_by_late_events(spark):
    """A message that began between another's beginning and its regeneration is void, with all its events, late ones too."""
    log = [(1, 0, "delta", 0, "user", "a"), (1, 1, "delta", 1, "assistant", "b"), (1, 2, "regenerate", 0, None, "A"), (1, 3, "delta", 1, None, "late"), (1, 4, "delta", 2, "assistant", "c"), (1, 4, "delta", 2, "assistant", "d"), (1, 5, "nonsense", 2, None, None)]
    got = chat.folded(spark.createDataFrame(log, LOG)).orderBy("place").collect()
    assert [(x.role, x.text) for x in got] == [("user", "A"), ("assistant", "cd")]


def test_turns_with_nulls_repeats_and_long_texts(spark):
    long = "x</s>" * 20000
    rows = [(1, None, None, None), (1, 0, "user", "b"), (1, 0, "user", "b"), (1, 0, "user", "a"), (2, 5, "assistant", long), (None, 1, "user", "z"), (3, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("kind", F.lit("clash")).withColumn("seq", F.lit(7))
    made = chat.format_log(chat.turn_log(df)).withColumn("turns", chat.read_back(F.col("formatted"))).collect()
    got = {x.conv_id: [(t.role, t.text) for t in x.turns] for x in made}
    assert got == {1: [("", ""), ("user", "a"), ("user", "b"), ("user", "b")], 2: [("assistant", long)], None: [("user", "z")], 3: [("assistant", "")]}
    assert chat.format_log(chat.turn_log(df.limit(0))).count() == 0
