"""Conversations with every text: against their SQL, and against the turns themselves."""

import json

import duckdb
import pytest

from cyclelens.llm import chat
from cyclelens.llm.queries import ORACLES, QUERIES
from tests.compare import differences
from tests.conftest import SF

CONVERSATIONS = "conv_id long, turn long, role string, text string"


def items(spark, rows):
    schemas = spark.createDataFrame(chat.SCHEMAS, "tool string, param string, type string, required boolean")
    calls, results, messages = chat.as_items(spark.createDataFrame(rows, CONVERSATIONS))
    return chat.formatted(calls, results, schemas, messages).collect()


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_whole_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    assert differences(spark, con, "op1_chat", sf, QUERIES, ORACLES) is None


def test_every_text_is_in_its_own_item(spark):
    rows = [(1, 0, "system", "Be \"brief\"\n"), (1, 1, "user", "q 1"), (1, 2, "assistant", "a long answer " * 500), (1, 3, "user", "q 2"), (1, 4, "assistant", "é 漢")]
    got = items(spark, rows)
    said = sorted((r.conv_id, {"call": "assistant", "result": "user"}.get(r.kind, json.loads(r.json).get("role")), json.loads(r.json)["content"]) for r in got)
    assert said == sorted((c, role, text) for c, _, role, text in rows)
    assert [r.kind for r in sorted(got, key=lambda r: r.position)] == ["message", "result", "call", "result", "call"]
    assert all(list(json.loads(r.json)) == sorted(json.loads(r.json)) for r in got)


FLAWED = [
    (1, 0, "user", "q"), (1, 0, "user", "q"), (1, 0, "user", "another q"), (1, 0, "tool", "t"), (1, 1, "assistant", "x y"), (1, 1, "assistant", "x"), (1, 1, None, "nobody"),
    (1, 2, "user", None), (1, 2, "user", None), (1, 3, "assistant", None), (None, 0, "user", "lost"), (None, 0, "assistant", "lost too"), (None, None, None, None),
    (2, None, "user", "no turn"), (2, None, "assistant", "no turn"), (2, 0, "system", "s"), (2, 1, "assistant", "after system"), (3, 5, "tool", ""),
    (4, -1, "assistant", "m"), (4, 0, "user", "n"), (4, 1, "assistant", "o"), (4, 1, "assistant", ""), (4, 3, "assistant", "p"),
]


def test_flawed_rows_have_an_item_each(spark):
    got = items(spark, FLAWED)
    said = [(r.conv_id, {"call": "assistant", "result": "user"}.get(r.kind, json.loads(r.json).get("role")), json.loads(r.json)["content"]) for r in got]
    assert sorted(map(str, said)) == sorted(str((c, role, text)) for c, _, role, text in set(FLAWED))
    status = {(r.conv_id, json.loads(r.json)["content"], r.kind): r.status for r in got}
    assert status[1, "x", "call"] == "linked" and status[1, "x y", "call"] == "unnamed" and status[1, "t", "message"] == "plain"
    assert status[None, "lost", "result"] == "orphan" and status[None, "lost too", "call"] == "unnamed" and status[2, "no turn", "result"] == "orphan"


def test_flawed_rows_match_sql(spark, tmp_path):
    spark.createDataFrame(FLAWED, CONVERSATIONS).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert differences(spark, con, "op1_chat", str(tmp_path), QUERIES, ORACLES) is None
