"""Ordered conversations from message rows: turns, speakers, reply links and link trees."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from veilframe.operators.ranking import spread_rank
from veilframe.session import written

#: Characters without a visible form, for the test of blank content (Java pattern).
INVISIBLE = r"[\s\p{Z}\p{Cc}\p{Cf}\x{34f}\x{3164}\x{115f}\x{1160}\x{fe00}-\x{fe0f}]"
#: A turn is linked to one of so many turns before it, at most; None: to any turn before it.
LOOKBACK = None
#: Rows of one task's block of a conversation.
BLOCK = 512
#: What a link is scored by, and the weights used where none are estimated; `opens` is the score of opening a thread.
WEIGHTS = {"time": 1.2, "turns": 0.9, "speaker": 0.6, "words": 1.5, "codes": 1.5, "names": 0.4, "answer": 0.3, "opens": 0.75}
#: Planted channels that weights are estimated on, at most, and turns of a channel among them.
PLANTED, PLANTED_TURNS = 400, 60


def speaker_of(sender_type: Column, message_type: Column) -> Column:
    """'customer', 'agent' or null. sender_type decides, in any case and spacing; if blank, message_type.

    A known sender_type that contradicts message_type gives null (and so does an unknown one).
    """
    kind = F.regexp_replace(F.lower(F.coalesce(sender_type, F.lit(""))), r"[\s_\-\p{Z}]+", "")
    named = F.when(kind == "contact", "customer").when(kind.isin("user", "agentbot", "bot"), "agent")
    typed = F.when(message_type == 0, "customer").when(message_type == 1, "agent")
    return F.when(kind == "", typed).when(named.isNotNull() & (message_type.isNull() | (typed == named)), named)


def link_features(content: Column) -> Column:
    """What links are scored by: 32-bit hashes of the distinct words, of those that are codes or numbers and of names, and whether it asks.

    The content itself isn't carried through the shuffles; it can be joined back by message_id.
    """
    words = F.array_distinct(F.filter(F.split(F.lower(content), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 2))
    names = F.regexp_extract_all(content, F.lit(r"(?<![.!?] )(?<!^)(?<!\p{L})(\p{Lu}\p{Ll}{2,})"), 1)
    return F.struct(
        F.transform(words, lambda w: F.hash(w)).alias("words"),
        F.transform(F.filter(words, lambda w: w.rlike(r"\p{N}{3,}")), lambda w: F.hash(w)).alias("codes"),
        F.transform(F.array_distinct(names), lambda w: F.hash(F.lower(w))).alias("names"),
        content.contains("?").alias("asks"),
    )


def turns(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """The turns of every kept conversation: conversation_id, turn_no, message_id, speaker, created_at, said (see link_features).

    A turn is a distinct message (by id, the latest copy by updated_at) that is not private, of
    message_type 0, 1 or null, whose content has something visible. A conversation is kept if it has
    a row in conversations, each turn has a time and a speaker (see speaker_of), and an agent's turn
    comes after the first customer's. Turns are ordered by created_at, then id, from 1. Messages without an id or a
    conversation_id belong to no conversation. A hot conversation is numbered in many tasks
    (spread_rank). Extra columns are ignored.
    """
    m = messages.select("id", "conversation_id", "sender_type", "message_type", "content", "private", "created_at", "updated_at")
    visible = F.length(F.regexp_replace("content", INVISIBLE, "")) > 0
    usable = (~F.coalesce(F.col("private"), F.lit(False))) & (F.col("message_type").isNull() | F.col("message_type").isin(0, 1)) & visible
    m = m.filter("id is not null and conversation_id is not null").filter(usable)
    m = m.select(
        F.col("id").cast("long").alias("message_id"), F.col("conversation_id").cast("long").alias("conversation_id"),
        speaker_of(F.col("sender_type"), F.col("message_type")).alias("speaker"), "created_at", "updated_at", "content",
    )
    never = F.to_timestamp_ntz(F.lit("0001-01-01 00:00:00"))
    latest = F.struct(F.coalesce("updated_at", never), "conversation_id", F.coalesce("created_at", never))
    one = m.groupBy("message_id").agg(F.max_by(F.struct("conversation_id", "speaker", "created_at", "content"), latest).alias("r")).select("message_id", "r.*")
    # Each conversation is judged on a partial aggregate; no conversation is gathered in a task.
    at = F.struct("created_at", "message_id")
    facts = one.groupBy("conversation_id").agg(
        F.count_if(F.col("created_at").isNull() | F.col("speaker").isNull()).alias("unknown"),
        F.min(F.when(F.col("speaker") == "customer", at)).alias("first_customer"),
        F.max(F.when(F.col("speaker") == "agent", at)).alias("last_agent"),
    )
    present = conversations.select(F.col("id").cast("long").alias("conversation_id"))
    sound = facts.filter("unknown = 0 and first_customer is not null and last_agent > first_customer").join(present, "conversation_id", "left_semi").select("conversation_id")
    kept = one.join(sound, "conversation_id", "left_semi")
    kept = kept.select("conversation_id", "message_id", "speaker", "created_at", link_features(F.col("content")).alias("said"))
    return spread_rank(kept, ["conversation_id"], ["created_at", "message_id"], "turn_no")


def _features(p: Column) -> dict[str, Column]:
    """What the link from a turn to an earlier turn p is scored by: nearness in time and in turns, change of speaker, lexical overlap, a shared code or
    number, a mention of a name used in the other turn, and a question before an answer."""
    both = F.size(F.array_intersect(p["words"], F.col("words")))
    least = F.greatest(F.least(F.size(p["words"]), F.size("words")), F.lit(1))
    gap = F.greatest(F.col("secs") - p["secs"], F.lit(0.0))
    return {
        "time": 1 / (1 + F.log1p(gap / 60)), "turns": 1 / (F.col("turn_no") - p["turn_no"]), "speaker": (p["speaker"] != F.col("speaker")).cast("double"), "words": both / least,
        "codes": F.arrays_overlap(p["codes"], F.col("codes")).cast("double"), "names": F.arrays_overlap(p["names"], F.col("words")).cast("double"), "answer": (p["asks"] & ~F.col("asks")).cast("double"),
    }


def reply_links(turns_: DataFrame, lookback: int | None = LOOKBACK, block: int = BLOCK, weights: dict[str, float] | None = None) -> DataFrame:
    """Adds parent_no, the turn answered by this one (null: it opens a thread), and link_score.

    Each turn before a turn (of the last `lookback`, if given) is scored (see _features; weights: WEIGHTS, or those of estimate_weights). The best score wins; on ties the
    nearest turn. A turn scoring under the weight `opens` on every candidate opens a thread. A
    conversation longer than `block` is cut in blocks: a turn is scored against its own block, then
    against each earlier block, and the best of all counts, so no conversation is one task's. The work of
    a long conversation grows with the square of its turns.
    """
    used = WEIGHTS | (weights or {})
    secs = F.unix_micros(F.col("created_at").cast("timestamp")) / F.lit(1e6)
    base = turns_.select("conversation_id", "turn_no", "message_id", "speaker", "created_at", "said.*", secs.alias("secs"))
    home = F.floor((F.col("turn_no") - 1) / block)
    turn = F.struct("turn_no", "speaker", "words", "codes", "names", "asks", "secs")
    base = written(base.withColumn("block", home), "turns")  # read again for the long conversations
    w = Window.partitionBy("conversation_id", "block").orderBy("turn_no").rowsBetween(-(block if lookback is None else lookback), -1)
    near = base.withColumn("before", F.collect_list(turn).over(w))

    def score(p: Column) -> Column:
        total = F.lit(0.0)
        for k, x in _features(p).items():
            total = total + F.coalesce(x, F.lit(0.0)) * used[k]
        return total

    best = F.array_max(F.transform("before", lambda p: F.struct(score(p).alias("s"), p["turn_no"].alias("n"))))
    linked = near.withColumn("best", best)
    many = base.filter("block > 0").select("conversation_id").distinct()
    if not many.isEmpty():
        long = base.join(many, "conversation_id", "left_semi")
        earlier = long.groupBy("conversation_id", "block").agg(F.collect_list(turn).alias("before")).withColumnRenamed("block", "from_block")
        oldest = F.lit(0) if lookback is None else F.greatest(F.floor((F.col("turn_no") - 1 - lookback) / block), F.lit(0))
        later = long.filter("block > 0").withColumn("from_block", F.explode(F.filter(F.sequence(oldest.cast("long"), F.col("block")), lambda k: k < F.col("block"))))
        met = later.join(earlier, ["conversation_id", "from_block"])
        if lookback is not None:
            met = met.withColumn("before", F.filter("before", lambda p: p["turn_no"] >= F.col("turn_no") - lookback))
        far = met.select("conversation_id", "turn_no", best.alias("far")).groupBy("conversation_id", "turn_no").agg(F.max("far").alias("far"))
        linked = linked.join(far, ["conversation_id", "turn_no"], "left").withColumn("best", F.greatest("best", "far"))
    linked = linked.withColumn("opens", F.coalesce(F.col("best.s") < used["opens"], F.lit(True)))
    return linked.select(
        "conversation_id", "block", "turn_no", "message_id", "speaker", "created_at",
        F.when(~F.col("opens"), F.col("best.n")).alias("parent_no"), F.col("best.s").alias("link_score"),
    )


def link_trees(links: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds thread_no: the first turn of the tree of reply links that a turn belongs to.

    Parents come before their children, so within a block one pass settles every turn, either to an
    opening turn or to a turn of an earlier block; only those of conversations with more than one block
    are then followed over the blocks, on one row per turn referred to.
    """
    fields = links.columns
    blocks = (
        links.groupBy("conversation_id", "block")
        .agg(F.array_sort(F.collect_list(F.struct("turn_no", *[c for c in fields if c not in ("turn_no", "conversation_id", "block")]))).alias("rows"))
    )
    first = F.element_at("rows", 1)["turn_no"]

    def top(acc: Column, x: Column) -> Column:
        inside = F.get(acc, (x["parent_no"] - first).cast("int"))
        return F.concat(acc, F.array(F.when(x["parent_no"].isNull(), x["turn_no"]).when(x["parent_no"] < first, x["parent_no"]).otherwise(inside)))

    tops = F.aggregate("rows", F.array().cast("array<bigint>"), top)
    settled = blocks.select("conversation_id", "block", F.explode(F.arrays_zip(F.col("rows").alias("rows"), tops.alias("top_no"))).alias("x"))
    settled = settled.select("conversation_id", "block", "x.rows.*", "x.top_no")
    settled = written(settled, "trees")
    many = settled.filter("block > 0").select("conversation_id").distinct()
    outer = settled.filter(F.floor((F.col("top_no") - 1) / block) < F.col("block")).join(many, "conversation_id", "left_semi")
    jumps = outer.select("conversation_id", F.col("top_no").alias("from_no")).distinct()
    if jumps.isEmpty():
        return settled.withColumnRenamed("top_no", "thread_no").drop("block")
    ends_of = settled.join(many, "conversation_id", "left_semi").select("conversation_id", F.col("turn_no").alias("from_no"), F.col("top_no").alias("to_no"))
    chain = written(jumps.join(ends_of, ["conversation_id", "from_no"]), "chain")
    while True:  # pointer doubling: the number of rounds is the logarithm of the number of blocks
        nxt = chain.select("conversation_id", F.col("from_no").alias("to_no"), F.col("to_no").alias("then_no"))
        chain = written(chain.join(nxt, ["conversation_id", "to_no"], "left").select("conversation_id", "from_no", F.coalesce("then_no", "to_no").alias("to_no"), (F.col("then_no").isNotNull() & (F.col("then_no") != F.col("to_no"))).alias("moved")), "chain")
        if chain.filter("moved").isEmpty():
            break
        chain = chain.drop("moved")
    ends = chain.select("conversation_id", F.col("from_no").alias("top_no"), F.col("to_no").alias("end_no"))
    return settled.join(ends, ["conversation_id", "top_no"], "left").withColumn("thread_no", F.coalesce("end_no", "top_no")).drop("top_no", "end_no", "block")


def planted_channels(turns_: DataFrame, seed: int = 0) -> DataFrame:
    """Conversations interleaved two by two, so that the parent of every turn is known: conversation_id (of the channel), turn_no, message_id, speaker,
    created_at, said, true_parent (the turn before it in its own conversation; null for its first).

    Of each pair, in a random order, the second begins within the first quarter of an hour of the first. An odd conversation stays alone. All
    positions are taken over many tasks (spread_rank) or by joins on the turn before, so no conversation is one task's.
    """
    heads = turns_.groupBy("conversation_id").agg(F.min("created_at").alias("began"))
    order = spread_rank(heads.withColumn("h", F.xxhash64(F.lit(seed), F.col("conversation_id"))).withColumn("one", F.lit(1)), ["one"], ["h", "conversation_id"], "r")
    pair, second = F.floor((F.col("r") - 1) / 2), (F.col("r") - 1) % 2
    late = second * F.pmod(F.xxhash64(F.lit(seed + 1), F.col("conversation_id")), F.lit(900))
    at = order.select("conversation_id", "began", pair.alias("channel"), late.alias("late"))
    t = turns_.join(at, "conversation_id")
    secs = F.unix_micros(F.col("created_at").cast("timestamp")) / F.lit(1e6) - F.unix_micros(F.col("began").cast("timestamp")) / F.lit(1e6) + F.col("late")
    t = t.select(F.col("channel").alias("conversation_id"), F.col("conversation_id").alias("own"), F.col("turn_no").alias("own_no"), "message_id", "speaker", F.timestamp_seconds(secs).alias("created_at"), "said")
    t = written(spread_rank(t, ["conversation_id"], ["created_at", "own", "own_no"], "turn_no"), "planted")
    before = t.select("own", (F.col("own_no") + 1).alias("own_no"), F.col("turn_no").alias("true_parent"))
    return t.join(before, ["own", "own_no"], "left").drop("own", "own_no")


def link_accuracy(planted: DataFrame, links: DataFrame) -> DataFrame:
    """(n_turns, n_right, n_linked, n_linked_right, n_opening, n_opening_right): of the turns of planted channels those with the right parent, apart for turns with a parent and without."""
    j = planted.select("conversation_id", "turn_no", "true_parent").join(links.select("conversation_id", "turn_no", "parent_no"), ["conversation_id", "turn_no"])
    right = F.col("true_parent").eqNullSafe(F.col("parent_no"))
    opens = F.col("true_parent").isNull()
    return j.agg(F.count(F.lit(1)).alias("n_turns"), F.count_if(right).alias("n_right"), F.count_if(~opens).alias("n_linked"), F.count_if(~opens & right).alias("n_linked_right"), F.count_if(opens).alias("n_opening"), F.count_if(opens & right).alias("n_opening_right"))


def estimate_weights(planted: DataFrame, channels: int = PLANTED, seed: int = 5) -> dict[str, float]:
    """Weights by which the true parents of a bounded sample of planted channels (about `channels`, of at most PLANTED_TURNS turns) are the likeliest: softmax regression over each turn's candidates and the
    choice to open a thread. WEIGHTS where there is nothing to learn from."""
    short = planted.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(2, PLANTED_TURNS))
    total = short.count()
    if not total:
        return dict(WEIGHTS)
    rate = min(1.0, channels / total)
    some = short.filter(F.pmod(F.xxhash64(F.lit(seed), F.col("conversation_id")), F.lit(1_000_000)) < int(rate * 1_000_000)).select("conversation_id")
    secs = F.unix_micros(F.col("created_at").cast("timestamp")) / F.lit(1e6)
    base = planted.join(some, "conversation_id").select("conversation_id", "turn_no", "true_parent", "speaker", "said.*", secs.alias("secs"))
    turn = F.struct("turn_no", "speaker", "words", "codes", "names", "asks", "secs")
    w = Window.partitionBy("conversation_id").orderBy("turn_no").rowsBetween(Window.unboundedPreceding, -1)
    names = [k for k in WEIGHTS if k != "opens"]

    def row(p: Column) -> Column:
        f = _features(p)
        return F.array(p["turn_no"].cast("double"), *[F.coalesce(f[k], F.lit(0.0)) for k in names])

    rows = base.withColumn("before", F.collect_list(turn).over(w)).filter(F.size("before") > 0).select("true_parent", F.transform("before", row).alias("f")).collect()
    # Each turn's candidates, with the choice to open a thread as the last.
    x, owner, gold = [], [], []
    for i, r in enumerate(rows):
        for v in r["f"]:
            x.append([*v[1:], 0.0])
            owner.append(i)
            gold.append(r["true_parent"] is not None and v[0] == r["true_parent"])
        x.append([0.0] * len(names) + [1.0])
        owner.append(i)
        gold.append(r["true_parent"] is None)
    if not x:
        return dict(WEIGHTS)
    x, owner, gold = np.array(x), np.array(owner), np.array(gold, dtype=float)
    starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    v = np.array([*(WEIGHTS[k] for k in names), WEIGHTS["opens"]])
    squares = np.full(len(v), 1e-6)
    for _ in range(400):
        z = x @ v
        p = np.exp(z - np.maximum.reduceat(z, starts)[owner])
        p /= np.add.reduceat(p, starts)[owner]
        g = x.T @ (gold - p) / len(rows) - 1e-3 * v
        squares += g * g
        v += 0.3 * g / np.sqrt(squares)
    return {k: float(a) for k, a in zip([*names, "opens"], v)}


def rebuild_conversations(messages: DataFrame, conversations: DataFrame, lookback: int | None = LOOKBACK, weights: dict[str, float] | None = None) -> DataFrame:
    """Every turn of every kept conversation with its speaker, parent turn and thread.

    Columns: conversation_id, turn_no, message_id, speaker, created_at, parent_no, link_score, thread_no.
    See turns, reply_links and link_trees. Empty tables give an empty result.
    """
    return link_trees(reply_links(turns(messages, conversations), lookback, weights=weights))
