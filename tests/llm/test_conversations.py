"""The prefix trie of conversations against one built turn by turn."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shelfcast.llm import conversations
from shelfcast.llm.conversations import numbered_turns, prefix_trie, share_beginnings

SCHEMA = "conv_id long, turn long, role string, text string, n string, owner string, depth string"


def ordered(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    return {c: [(t[2], t[4]) for t in sorted(v)] for c, v in own.items()}


def rebuilt(own):
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(int(c - (abs(c) % 100) * (1 if c >= 0 else -1)), [])[:h] + own[c][h:]
    return out


def trie(convs):
    members, children, below = defaultdict(list), defaultdict(list), {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    for node in sorted(members, key=len, reverse=True):
        leaves = sum(below[x][0] for x in children[node]) if children[node] else 1
        saved = sum(below[x][1] for x in children[node]) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
        below[node] = leaves, saved
    out = set()
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(node))
        out.add((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), *below[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def nodes(steps):
    rows = prefix_trie(steps).collect()
    assert len(rows) == len({(r.conv_id, r.depth) for r in rows})
    return {tuple(r) for r in rows}


def shared(own):
    conv = F.col("conv_id")
    return share_beginnings(own, conv - conv % 100, F.crc32(conv.cast("string")) % 6, 5)


@pytest.fixture(scope="module")
def talk():
    """Long and short paths over few texts, copies, nulls, equal and null turns, repeated rows, ids without a model."""
    rnd = random.Random(11)
    rows = []
    for c in [*range(-30, 60), *range(300, 340), *range(1007, 1030), 2**40 + 1]:
        for t in range(rnd.choice((1, 2, 3, 5, 8, 9, 13))):
            rows.append((c, rnd.choice((t, t, t, None)), rnd.choice(("user", "user", "", None)), rnd.choice(("a", "a", "a", "bé😀", None, ""))))
    copied = [(t, "user", f"line {t}") for t in range(11)]
    rows += [(c, *x) for c in range(5000, 5080) for x in copied[: 11 if c % 3 else c % 11]]
    rows += [(7, 3, "user", "same"), (7, 3, "user", "same"), (7, 3, "assistant", "same"), (None, 1, "user", "no id"), (8, 1, "user", "x " * 50_000)]
    return [(*r, "x", "x", "x") for r in rows]


def test_trie_of_shared_beginnings(spark, talk, monkeypatch):
    monkeypatch.setattr(conversations, "PIECE", 7)  # lists of ids in several pieces
    df = spark.createDataFrame(talk, SCHEMA)
    assert nodes(shared(numbered_turns(df.repartition(5)))) == trie(rebuilt(ordered(talk)))


def test_trie_as_it_is(spark, talk):
    df = spark.createDataFrame(talk, SCHEMA)
    assert nodes(numbered_turns(df)) == trie(ordered(talk))


def test_few_conversations(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert nodes(shared(numbered_turns(empty))) == set()
    one = [(5, None, None, None, "x", "x", "x")]  # h turns of a conversation that isn't there, and none left of its own
    assert zlib.crc32(b"5") % 6 > 0
    assert nodes(shared(numbered_turns(spark.createDataFrame(one, SCHEMA)))) == trie({5: []}) == {(5, 0, None, 1, 0, 1, 0, hashlib.sha256(b"5").hexdigest())}
