"""Word lists: the automaton and the chain of searches agree with a plain loop, and the texts are passed once."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from tidemark.config import training_config
from tidemark.functions import words
from tidemark.operators import communication
from tidemark.plans.registry import Run

LISTS = (("abc", "b", "票", "高铁"), (), ("bc", "abc", "𝒳y", "b c"), ("zz.*", "[", "\\E"), ("",), ("never",))
TEXTS = ["", None, "abc", "xbcx", "b c", "坐高铁去", "𝒳y", "𝒳", "zz.*", "zzz", "[", "a\\Eb", "a\nb\0c", "ABC", "abc" * 50_000]


def plain(text, listed):
    return None if text is None else any(word in text for word in listed)


def flags(table, lists):
    found = words.mentions(F.col("text"), lists)
    return table.select("text", *[c.alias(f"l{i}") for i, c in enumerate(found)])


@pytest.mark.parametrize("chain", [0, 99])
def test_as_a_loop(spark, monkeypatch, chain):
    monkeypatch.setattr(words, "CHAIN_WORDS", chain)
    table = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    for row in flags(table, LISTS).collect():
        assert tuple(row)[1:] == tuple(plain(row["text"], listed) for listed in LISTS), row["text"]
    assert flags(table.filter("false"), LISTS).isEmpty()


def test_random_words_of_few_letters(spark, monkeypatch):
    monkeypatch.setattr(words, "CHAIN_WORDS", 0)
    draw = random.Random(3)

    def word(most):
        return "".join(draw.choice("ab票") for _ in range(draw.randrange(1, most)))

    lists = [[word(7) for _ in range(draw.randrange(1, 6))] for _ in range(words.MOST_LISTS)]
    table = spark.createDataFrame([(word(30),) for _ in range(300)], "text string")
    for row in flags(table, lists).collect():
        assert tuple(row)[1:] == tuple(plain(row["text"], listed) for listed in lists)
    with pytest.raises(ValueError, match="at most 62"):
        words.mentions(F.col("text"), [*lists, ["a"]])


def test_a_thousand_words_in_one_pass(spark):
    """A chain of a thousand searches cannot even be planned; both lists come from one Python evaluation."""
    lists = [[f"word{n}" for n in range(500)], [f"term{n}" for n in range(500)]]
    table = spark.range(2000).select(F.concat(F.lit("a word"), "id", F.lit(" b term"), F.col("id") + 400).alias("text"))
    found = flags(table, lists)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [mask(") == 1 and plan.count("mask(text") == 1
    # word1999 holds word1, so every number whose first digits are below 500 counts.
    want = [sum(plain(f"a word{n} b term{n + 400}", listed) for n in range(2000)) for listed in lists]
    assert list(found.agg(F.sum(F.col("l0").cast("int")), F.sum(F.col("l1").cast("int"))).first()) == want


def test_chats_under_long_lists(spark, monkeypatch):
    """The chats of the test tables, by the automaton and by the chain."""
    run = Run(spark, "/root/testdata/sf0.001", training_config())
    tables = {}
    for chain in (words.CHAIN_WORDS, 0):
        monkeypatch.setattr(words, "CHAIN_WORDS", chain)
        daily = communication.service_chat_daily(run.src.service_chat, run.cfg)
        tables[chain] = sorted(map(tuple, daily.collect()), key=str)
    assert len(tables) == 2 and len(set(map(str, tables.values()))) == 1
    longer = replace(run.cfg, words=replace(run.cfg.words, vacation_words=(*run.cfg.words.vacation_words, *(f"\x01{n}" for n in range(900)))))
    monkeypatch.undo()
    daily = communication.service_chat_daily(run.src.service_chat, longer)
    assert sorted(map(tuple, daily.collect()), key=str) == tables[0]
