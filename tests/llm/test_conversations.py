import datetime as dt
import random

from pyspark.sql import functions as F

from veilframe.llm import conversations as cv
from veilframe.llm.conversations import WEIGHTS, estimate_weights, link_accuracy, link_features, planted_channels, reply_links

SCHEMA = "id int, conversation_id int, sender_type string, message_type int, content string, private boolean, created_at timestamp_ntz, updated_at timestamp_ntz, turn_no int"


def _msg(i, c, s, t, text="текст", private=False, at=None, upd=0):
    base = dt.datetime(2024, 1, 1)
    return (i, c, s, t, text, private, base + dt.timedelta(seconds=i if at is None else at) if at != "none" else None, base + dt.timedelta(days=upd), 99)


def test_turns_and_rules(spark):
    rows = [
        _msg(1, 1, "Contact", 0, at=50), _msg(2, 1, " user", 1, at=50), _msg(3, 1, None, 0), _msg(3, 1, None, 0, upd=5), _msg(4, 1, "Agent Bot", None), _msg(5, 1, "Contact", 2), _msg(6, 1, "x", 0, "​ "), _msg(7, 1, "user", 1, private=True),
        _msg(10, 2, "contact", 0), _msg(11, 2, "contact", 1),  # contradictory
        _msg(20, 3, "user", 1), _msg(21, 3, "contact", 0),  # never answered
        _msg(30, 4, "contact", 0), _msg(31, 4, "user", 1, at="none"),  # a time missing
        _msg(40, 5, "contact", 0), _msg(41, 5, "user", 1),  # no conversation row
        _msg(50, None, "contact", 0), _msg(60, 6, "", None),
    ]
    m = spark.createDataFrame(rows, SCHEMA)
    c = spark.createDataFrame([(1,), (1,), (2,), (3,), (4,), (6,), (None,)], "id int")
    got = sorted((r["conversation_id"], r["turn_no"], r["message_id"], r["speaker"]) for r in cv.rebuild_conversations(m, c).collect())
    assert got == [(1, 1, 3, "customer"), (1, 2, 4, "agent"), (1, 3, 1, "customer"), (1, 4, 2, "agent")]
    assert cv.rebuild_conversations(m.limit(0), c).count() == 0 and cv.rebuild_conversations(m, c.limit(0)).count() == 0


def test_trees_over_blocks(spark):
    """A conversation over many blocks is linked as it is in one."""
    rows = [_msg(i, 1, "contact" if i % 3 else "user", 0 if i % 3 else 1, f"вопрос {i // 7} про заказ {i % 5}00{i % 5}" + "?" * (i % 2), at=i * (1 if i % 11 else 4000)) for i in range(1, 121)]
    m, c = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(1,)], "id int")
    t = cv.turns(m, c)
    whole = cv.link_trees(cv.reply_links(t, 6, 1000), 1000)
    parts = cv.link_trees(cv.reply_links(t, 6, 8), 8)
    key = lambda df: sorted((r["turn_no"], r["parent_no"] or 0, r["thread_no"]) for r in df.collect())
    assert key(whole) == key(parts)
    parent = {n: p for n, p, _ in key(whole)}
    for n, p, top in key(whole):
        while p:
            n, p = p, parent[p]
        assert n == top


def test_late_reply_is_tied_to_its_turn(spark):
    """A reply 40 turns later finds the turn whose order code, name and words it shares, within a block and over blocks."""
    rows = [_msg(1, 1, "contact", 0, "Где посылка для Марины по заказу 774512?")]
    rows += [_msg(i, 1, "user" if i % 2 else "contact", 1 if i % 2 else 0, f"тема{i} слово{i}", at=i * 60) for i in range(2, 41)]
    rows += [_msg(41, 1, "user", 1, "посылка для марины по заказу 774512 уже едет", at=41 * 60)]
    t = cv.turns(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(1,)], "id int"))
    for block in (512, 8):
        assert {r["turn_no"]: r["parent_no"] for r in cv.reply_links(t, block=block).collect()}[41] == 1


def test_whole_conversation_is_scored_alike_over_blocks(spark):
    rows = [_msg(i, 1, "contact" if i % 3 else "user", 0 if i % 3 else 1, f"вопрос {i // 7} про заказ {i % 5}00{i % 5}" + "?" * (i % 2), at=i * (1 if i % 11 else 4000)) for i in range(1, 121)]
    t = cv.turns(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(1,)], "id int"))
    key = lambda df: sorted((r["turn_no"], r["parent_no"] or 0, r["thread_no"]) for r in df.collect())
    assert key(cv.link_trees(cv.reply_links(t))) == key(cv.link_trees(cv.reply_links(t, block=8), 8))


def test_planted_threads_are_disentangled_with_estimated_weights(spark):
    """Pairs of interleaved conversations whose turns repeat an order code of their own: parents are known, weights are estimated on other channels."""
    r = random.Random(4)
    rows, day = [], dt.datetime(2024, 1, 1)
    for c in range(120):
        at = day + dt.timedelta(days=c)
        for k in range(r.randint(3, 6)):
            at += dt.timedelta(seconds=r.randint(5, 400))
            who = "customer" if k % 2 == 0 else "agent"
            text = f"{r.choice(['да', 'нет', 'хорошо', 'вот'])} заказ {700000 + c} {r.choice(['ждём', 'готов', 'где'])}"
            rows.append((c, k + 1, c * 10 + k, who, at, text))
    t = spark.createDataFrame(rows, "conversation_id long, turn_no long, message_id long, speaker string, created_at timestamp_ntz, text string")
    t = t.select("conversation_id", "turn_no", "message_id", "speaker", "created_at", link_features(F.col("text")).alias("said"))
    w = estimate_weights(planted_channels(t, 1))
    held = planted_channels(t, 2)
    assert held.count() == len(rows) and held.filter("true_parent >= turn_no").count() == 0
    assert held.filter("true_parent is null").count() == 120 and held.select("conversation_id").distinct().count() == 60
    got = link_accuracy(held, reply_links(held.drop("true_parent"), weights=w)).first()
    assert got["n_turns"] == len(rows) and got["n_right"] >= 0.85 * len(rows)
    assert w["codes"] > 1
    none = planted_channels(t.limit(0))
    assert none.count() == 0 and estimate_weights(none) == WEIGHTS
