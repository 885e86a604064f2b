import hashlib
import random

import pytest

from tilewright.llm import chat_format as m

SCHEMA = "conv_id long, turn long, role string, text string"


def want(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort(key=lambda t: (t[0], t[1].encode(), t[2].encode()))
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", m.PROBE), (-7, 1, "assistant", m.PROBE)]
    found = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in m.op9_chat_format(spark, sf).collect()}
    assert found == want(rows)


def test_matches_sql(spark, sf):
    import duckdb

    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert sorted(map(tuple, m.op9_chat_format(spark, sf).select(*names).collect())) == sorted(c.sql(f"SELECT {', '.join(names)} FROM ({m.ORACLE_SQL.strip()})").fetchall())


HOSTILE = ["</s>", "<s>", "[INST]", "[/INST]", "<|end|>", "<|user|>", "|>", "<|", "\\", "<\\", "\\\\", "<<SYS>>", "<</SYS>>", "$1", "\n", "<", "[", ">", "é\U0001f600", "x", "<|im_start|>", ""]


@pytest.mark.parametrize("seed", range(4))
def test_round_trip_of_hostile_texts(spark, seed):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choices(HOSTILE, k=rng.randrange(7)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", text()]), text()) for c in range(250) for t in range(rng.randint(1, 3))]
    df = m.read_back(m.format_conversations(spark.createDataFrame(rows, SCHEMA)))
    for r in df.collect():
        turns = sorted(((t, ro, x) for c, t, ro, x in rows if c == r.conv_id), key=lambda t: t[0])
        assert [tuple(t) for t in r.read_turns] == [(ro, x) for _, ro, x in turns]
        assert r.loss_text == "".join(x for _, ro, x in turns if ro == "assistant")
        assert r.formatted.count("<|end|>") == len(turns)
        for s in ("</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"):
            assert s not in r.formatted
        import re

        masked = "".join(re.sub(r"(?s)\\(.)", r"\1", r.formatted[s.start : s.end]) for s in r.loss_mask)
        assert masked == r.loss_text


def test_layouts(spark):
    rows = [
        ('{"prompt":"a","response":"b"}', [("user", "a"), ("assistant", "b")]),
        ('{"completion":"b","prompt":"a"}', [("user", "a"), ("assistant", "b")]),
        ('{"system":"s","prompt":"a","response":"b"}', [("system", "s"), ("user", "a"), ("assistant", "b")]),
        ('{"messages":[{"role":"user","content":"x"},{"role":"assistant","content":"y"}]}', [("user", "x"), ("assistant", "y")]),
        ('{"messages":[{"turn":2,"role":"assistant","text":"y"},{"turn":1,"role":"user","text":"x"}]}', [("user", "x"), ("assistant", "y")]),
        ('{"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":"g"}]}', [("user", "h"), ("assistant", "g")]),
        ('{"instruction":"i","input":"more","output":"o"}', [("user", "i\n\nmore"), ("assistant", "o")]),
        ('{"instruction":"i","output":"o"}', [("user", "i"), ("assistant", "o")]),
        ('{"messages":[{"content":"x"},{"role":"assistant","content":"y"}]}', [(None, "x"), ("assistant", "y")]),
        ('{"messages":[{"role":"user","content":"x"},{"role":"assistant","content":"y","more":1}]}', None),
        ('{"prompt":"[{\\"a\\":1}]","response":"b"}', [("user", '[{"a":1}]'), ("assistant", "b")]),
        ('{"unknown":1}', None), ("{}", None), ("not json", None), (None, None),
    ]
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(rows)], "i int, r string").withColumn("turns", m.json_turns("r"))
    for r in df.collect():
        assert (None if r.turns is None else [tuple(t) for t in r.turns]) == rows[r.i][1]


@pytest.mark.parametrize("ddl,sql", [("struct<prompt: string, response: string>", "named_struct('prompt', 'a', 'response', 'b')"), ("struct<x: int>", "named_struct('x', 1)")])
def test_typed_layouts(spark, ddl, sql):
    df = spark.sql(f"SELECT CAST({sql} AS {ddl}) AS record")
    turns = df.select(m.typed_turns(df, "record").alias("t")).first().t
    assert (turns is None) == ("x" in ddl)
    assert turns is None or [tuple(t) for t in turns] == [("user", "a"), ("assistant", "b")]


def test_rows_of_one_type_have_their_own_layouts(spark):
    sql = "SELECT 0 AS i, '{\"prompt\":\"a\",\"response\":\"b\"}' AS j UNION ALL SELECT 1, '{\"messages\":[{\"role\":\"user\"},{\"content\":\"y\"}]}' UNION ALL SELECT 2, '{\"conversations\":[{\"from\":\"human\",\"value\":\"h\"}]}' UNION ALL SELECT 3, '{\"prompt\":\"a\"}' UNION ALL SELECT 4, '{}'"
    df = spark.sql(sql).selectExpr("i", f"from_json(j, '{m.RECORD}') AS record")
    got = {r.i: r.turns and [tuple(t) for t in r.turns] for r in df.withColumn("turns", m.typed_turns(df, "record")).collect()}
    assert got == {0: [("user", "a"), ("assistant", "b")], 1: [("user", None), (None, "y")], 2: [("user", "h")], 3: None, 4: None}


def test_the_query_meets_several_layouts(spark, sf):
    """Its records have unlike fingerprints, also where roles are called as another layout calls them."""
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(10**6 + c, t, r, f"{c}") for c in range(30) for t, r in enumerate(["system", "user", "assistant"] if c % 2 else ["human", "gpt", "user"])], SCHEMA)
    records = m.conversations_as_records(rows.unionByName(more))
    marks = {tuple(p for p, _ in sorted(m.present_paths(records.schema["record"].dataType, "record")) if r[p]) for r in records.selectExpr("conv_id", *[f"{sql} AS `{p}`" for p, sql in m.present_paths(records.schema["record"].dataType, "record")]).collect()}
    assert len(marks) >= 4 and marks <= set(m.LAYOUTS)
    back = {r.conv_id: [tuple(t) for t in r.read_turns] for r in m.read_back(m.format_conversations(more)).collect()}
    assert back[10**6] == [("human", "0"), ("gpt", "0"), ("user", "0")] and back[10**6 + 1] == [("system", "1"), ("user", "1"), ("assistant", "1")]


def test_time_is_in_proportion_to_turns(spark):
    """32,000 turns of one conversation take about twice the time of 16,000, and their places are exact."""
    import time

    def seconds(n):
        df = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat('text ', id) AS text")
        began = time.time()
        r = m.read_back(m.format_conversations(df)).selectExpr("size(read_turns) AS n", "char_length(loss_text) AS c", "size(loss_mask) AS k").first()
        assert (r.n, r.k) == (n, n // 2) and r.c == sum(len(f"text {i}") for i in range(1, n, 2))
        return time.time() - began

    seconds(1000)
    assert seconds(32_000) < 3 * seconds(16_000) + 2


def test_odd_rows(spark):
    rows = [(None, 0, "user", "a"), (1, None, None, None), (1, 2, "assistant", "q" * 300_000), (1, 2, "assistant", "p"), (1, 2, "assistant", "p"), (2, 1, "assistant", None)]
    df = spark.createDataFrame([(*r, "z") for r in rows], SCHEMA + ", formatted string")
    got = {r.conv_id: (len(r.read_turns), len(r.loss_text)) for r in m.read_back(m.format_conversations(df)).collect()}
    assert got == {None: (1, 0), 1: (4, 300_002), 2: (1, 0)}
    assert m.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stays_in_the_jvm(spark, sf):
    plan = m.op9_chat_format(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
