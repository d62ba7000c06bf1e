"""Role repair against exhaustive search, language identification by held-out accuracy."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import chat, language


def legal(seq):
    body = list(seq[1:] if seq[:1] == ("system",) else seq)
    return body == ["user", "assistant"] * (len(body) // 2) and (len(seq) == 0 or len(body) > 0 or seq != ("system",))


def exhaustive(roles):
    """Least cost over all relabellings, merges and insertions of at most one empty turn between turns."""
    best = 1e9
    for names in itertools.product(chat.STATES[1:], repeat=len(roles)):
        own = sum(0 if a == b else chat.GUESS if a == "unknown" else chat.RELABEL for a, b in zip(roles, names, strict=True))
        for how in itertools.product(("plain", "merge", "user", "assistant"), repeat=len(roles)):
            seq, cost, fine = [], own, True
            for name, h in zip(names, how, strict=True):
                if h == "merge":
                    fine &= bool(seq) and seq[-1] == name
                    cost += chat.MERGE
                else:
                    if h != "plain":
                        seq.append(h)
                        cost += chat.INSERT
                    seq.append(name)
            if fine and cost < best:
                for tail in ((), ("assistant",), ("user", "assistant")):
                    if legal((*seq, *tail)):
                        best = min(best, cost + chat.INSERT * len(tail))
    return best


def test_repair_is_cheapest(spark):
    rng, turns, want = random.Random(3), [], {}
    for c in range(60):
        roles = [rng.choice(["system", "user", "assistant", "unknown"]) for _ in range(rng.randint(1, 4))]
        want[c] = exhaustive(roles)
        turns += [(c, n, {"unknown": None}.get(r, r.upper() + " "), f"t{c}.{n}", "x") for n, r in enumerate(roles)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, piece string")
    out = chat.format_chats(df)
    got = {r["conv_id"]: r for r in chat.rendered(out).collect()}
    assert {c: r["cost"] for c, r in got.items()} == want
    for c, r in got.items():
        seq = tuple(x.split("|>")[0] for x in r["chat"].split("<|")[1:] if not x.startswith("end"))
        assert legal(seq), (c, seq)
        assert all(t[3] in r["chat"] for t in turns if t[0] == c)
    assert out.count() == len(turns)


def test_long_conversation_crosses_partitions(spark):
    rng = random.Random(5)
    roles = [rng.choice(["user", "assistant", "system"]) for _ in range(4000)]
    df = spark.createDataFrame([(None, n, r, None) for n, r in enumerate(roles)] + [(7, 0, "user", "hi"), (7, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    out = chat.format_chats(df).persist()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    long = sorted((r for r in out.collect() if r["conv_id"] is None), key=lambda r: r["place"])
    whole = chat.repair(roles)
    assert len(long) == 4000
    assert len({r["place"] >> 33 for r in long}) > 1
    at, cost = 0, 0.0
    for r, s in zip(roles, whole, strict=True):
        cost += chat.MOVES[r][at][s][0]
        at = s
    assert sum(r["cost"] for r in long) == pytest.approx(cost + chat.END[at])
    assert {r["chat"] for r in chat.rendered(out.where("conv_id = 7")).collect()} == {"<|user|>\nhi\n\nhi\n<|end|>\n<|assistant|>\n\n<|end|>\n"}
    assert chat.format_chats(df.limit(0)).collect() == []


def test_ids_beyond_double_precision(spark):
    """Conversations and turns that differ in their last bit stay apart, with and without nulls beside them."""
    big = 2**60
    turns = [(c, t, r, f"{c}.{t}") for c in (big, big + 1, big + 2, None, 3) for t, r in ((big, "user"), (big + 1, "user"), (None, "system"), (big + 2, "assistant"))]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = chat.format_chats(df).collect()
    assert sorted(((r["conv_id"], r["turn"]) for r in got), key=repr) == sorted(((c, t) for c, t, _, _ in turns), key=repr)
    for c in {t[0] for t in turns}:
        own = sorted((r for r in got if r["conv_id"] == c), key=lambda r: r["place"])
        states = chat.repair([chat.role_of(r["role_in"]) for r in own])
        assert [r["role_out"] for r in own] == [chat.STATES[s] for s in states] == ["system", "user", "user", "assistant"]
        assert "".join(r["piece"] for r in own).count(f"{c}.") == 4
    names = spark.createDataFrame([("a", 1, "user", "x" * 300_000), ("b", 1, "user", "y"), (None, 1, "user", "z")], "conv_id string, turn long, role string, text string")
    assert sorted(len(r["piece"]) > 300_000 for r in chat.format_chats(names).collect()) == [False, False, True]


def test_language(spark):
    rng = random.Random(1)
    stems = {"aa": ["ming", "tor", "vel", "shan"], "bb": ["ñeo", "quis", "lár", "ción"]}
    rows = []
    for i in range(240):
        lang = ("aa", "bb")[i % 2]
        rows.append((i, " ".join("".join(rng.choices(stems[lang], k=3)) for _ in range(8)), lang, "clash", 0.5))
    rows += [(900, None, "aa", "", 0.0), (901, "123 ²!", "bb", "", 0.0), (902, "ming tor", None, "", 0.0), (None, "vel", "aa", "", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, word string, score double")
    got = {r["doc_id"]: r for r in language.identify_held_out(df).collect()}
    assert len(got) == len(rows)
    held = [i for i, r in got.items() if r["held_out"] and i is not None and i < 900]
    assert held and all(got[i]["lang_pred"] == ("aa", "bb")[i % 2] for i in held)
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[902]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.identify_held_out(df.limit(0)).collect() == []
    assert {r["lang_pred"] for r in language.predict(df, language.learn(df.where("lang is null"))).collect()} == {"und"}


def test_language_counts_are_whole(spark, monkeypatch):
    """Words and n-grams that workers do not hold count as exactly as those that they hold."""
    monkeypatch.setattr(language, "MOST_WORDS", 3)
    monkeypatch.setattr(language, "MOST_GRAMS", 2)
    monkeypatch.setattr(language, "BLOCK_TEXTS", 7)
    rng = np.random.default_rng(5)
    stems = {"a": ["lum", "sol", "tar", "ken"], "b": ["mul", "sul", "tark", "nek"], "c": ["zol", "lum", "rat", "ekn"]}
    rows = [(i, " ".join("".join(rng.choice(stems[x], 2)) for _ in range(rng.integers(0, 9))), x) for i, x in enumerate(rng.choice(list("abc"), 90).tolist())]
    asked = rows[:40] + [(100, "lumq sulw", None), (101, "qqq", None), (102, None, None), (103, "lumsol lumsol x", None)]

    def logs(counts):
        size = len({w for c in counts.values() for w in c})
        return lambda w: np.array([np.log((counts[x][w] + 0.5) / (sum(counts[x].values()) + 0.5 * size)) for x in "abc"]) if any(counts[x][w] for x in "abc") else None

    grams = lambda w, m: [f" {w} "[i : i + m] for i in range(len(w) + 3 - m)]
    words = {x: Counter(w for _, t, lang in rows if lang == x for w in t.split()) for x in "abc"}
    word = logs(words)
    gram = {m: logs({x: Counter(g for w, n in words[x].items() for g in grams(w, m) for _ in range(n)) for x in "abc"}) for m in (5, 4, 3, 2, 1)}

    def score(w):
        if word(w) is not None:
            return word(w)
        return next((np.mean(k, 0) for m in (5, 4, 3, 2, 1) if (k := [v for g in grams(w, m) if (v := gram[m](g)) is not None])), np.zeros(3))

    learnt = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = {r["doc_id"]: r for r in language.predict(spark.createDataFrame(asked, "doc_id long, text string, lang string"), learnt).collect()}
    assert len(got) == len(asked)
    for i, text, _ in asked:
        if not text:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        total = sum(score(w) for w in text.split())
        assert got[i]["lang_pred"] == "abc"[int(np.argmax(total))]
        assert abs(got[i]["score"] - 1 / np.exp(total - total.max()).sum()) < 1e-9
