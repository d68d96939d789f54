import itertools
import random

import pytest

from timberline.llm import chat
from timberline.llm.chat import BETWEEN, CLOSE, ENDING, INSERT, MERGE, RELABEL, UNKNOWN, format_chats, tag


def cost_of(codes, states):
    total, before = 0, 0
    for code, after in zip(codes, states):
        ways = [MERGE] if before == after else []
        ways += [INSERT * len(BETWEEN[before, after])] if (before, after) in BETWEEN else []
        if not ways:
            return None
        total += min(ways) + (UNKNOWN if code == 3 else 0 if code == after - 1 else RELABEL)
        before = after
    return total + INSERT * len(ENDING[before])


def best_cost(codes):
    return min(c for s in itertools.product((1, 2, 3), repeat=len(codes)) if (c := cost_of(codes, s)) is not None)


@pytest.mark.parametrize("bits", [1, 11])
def test_repairs_are_cheapest_and_legal(spark, monkeypatch, bits):
    monkeypatch.setattr(chat, "CHUNK_BITS", bits)
    rng = random.Random(bits)
    roles = ["system", "user", "assistant", " User ", "tool", None]
    convs = {c: [rng.choice(roles) for _ in range(rng.randint(1, 7))] for c in range(60)}
    rows = [(c, t, r, f"t{c}.{t} <|user|>", "x") for c, rs in convs.items() for t, r in enumerate(rs)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, piece string").repartition(6)
    got = format_chats(turns).collect()
    assert len(got) == len(rows)
    for c, rs in convs.items():
        mine = sorted((r for r in got if r.conv_id == c), key=lambda r: r.place)
        assert [r.place for r in mine] == list(range(len(rs))) and [r.turn for r in mine] == list(range(len(rs)))
        codes = [{"system": 0, "user": 1, "assistant": 2}.get((r or "").strip().lower(), 3) for r in rs]
        states = [chat.ROLES.index(r.new_role) + 1 for r in mine]
        assert cost_of(codes, states) == best_cost(codes)
        whole = "".join(r.piece for r in mine)
        parts = whole.split(CLOSE)
        assert parts[-1] == ""
        tags = [next(k for k in (1, 2, 3) if p.startswith(tag(k))) for p in parts[:-1]]
        legal = tags[1:] if tags[0] == 1 else tags
        assert legal == [2, 3] * (len(legal) // 2) and legal
        assert all(f"t{c}.{t} < |user|>" in whole for t in range(len(rs)))


def test_hot_conversation_repeated_rows_nulls_and_nothing(spark):
    schema = "conv_id long, turn int, role string, text string"
    rows = [(1, 0, "user", "same")] * 5000 + [(None, None, None, None), (None, 1, "assistant", ""), (2, None, "user", "b"), (2, 3, "user", "a")]
    got = format_chats(spark.createDataFrame(rows, schema).repartition(3)).collect()
    hot = sorted(r.place for r in got if r.conv_id == 1)
    assert hot == list(range(5000))
    assert [r.piece for r in sorted((r for r in got if r.conv_id == 2), key=lambda r: r.place)] == [
        "<|user|>\na", "\nb" + CLOSE + "<|assistant|>\n" + CLOSE]
    assert "".join(r.piece for r in sorted((r for r in got if r.conv_id is None), key=lambda r: r.place)).endswith(CLOSE)
    assert format_chats(spark.createDataFrame([], schema)).collect() == []


def test_texts_of_a_run_are_never_in_one_cell(spark):
    plan = format_chats(spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn int, role string, text string"))._jdf.queryExecution().optimizedPlan().toString()
    gathers = [x for x in plan.splitlines() if "collect_list" in x]
    assert gathers and not any("text" in x for x in gathers)


def test_many_long_texts_of_one_conversation(spark):
    rows = spark.range(300).selectExpr("1L AS conv_id", "CAST(id AS INT) AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "repeat(concat('<|', id, ' '), 50000) AS text")
    got = format_chats(rows).selectExpr("place", "action", "new_role", "length(piece) AS n", "left(piece, 40) AS head").collect()
    assert len(got) == 300 and {r.action for r in got} == {"keep"} and min(r.n for r in got) > 200_000
    assert sorted(r.place for r in got) == list(range(300)) and next(r.head for r in got if r.place == 1).startswith(f"{CLOSE}<|assistant|>\n< |1 < |1 ")


def test_long_texts_and_columns_of_other_names(spark):
    text = "word " * 100_000
    rows = [(1, 0, "user", text, "p", "k"), (1, 1, "assistant", "b", "p", "k")]
    got = sorted(format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, place string, key string")).collect(), key=lambda r: r.place)
    assert "".join(r.piece for r in got) == f"<|user|>\n{text}{CLOSE}<|assistant|>\nb{CLOSE}"
