"""JSON-RPC 2.0 lines as a DataFrame in and out: the protocol without its transport.

A stream of request lines (a file, a socket, standard input) becomes a DataFrame
with a column ``line``; the answers are one too, in batch or in a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scan import scanned

MOST_BYTES, MOST_TEXT = 4 << 20, 256 << 10
_TOOLS = '[{"name":"lint","inputSchema":{"type":"object","properties":{"text":{"type":"string"}},"required":["text"]}}]'
# Error codes of the protocol.
PARSE_ERROR, BAD_REQUEST, NO_METHOD, BAD_PARAMETERS = -32700, -32600, -32601, -32602


def _answer(result: Column) -> Column:
    return F.concat(F.lit('{"jsonrpc":"2.0","id":'), F.coalesce("id", F.lit("null")), F.lit(',"result":'), result, F.lit("}"))


def _error(code: int, message: str) -> Column:
    return F.concat(F.lit('{"jsonrpc":"2.0","id":'), F.coalesce("id", F.lit("null")), F.lit(f',"error":{{"code":{code},"message":"{message}"}}}}'))


def answers(requests: DataFrame, profile: str = "base") -> DataFrame:
    """One answer ``line`` for each request ``line`` that has an id; notifications have none.

    Malformed and oversized lines get the protocol's errors.  A call of ``lint``
    carries its issues as JSON text.
    """
    parsed = F.from_json("line", "jsonrpc string, id string, method string, params struct<name: string, arguments: struct<text: string>>")
    d = requests.select("line", parsed.alias("q")).select("line", F.to_json(F.struct(F.col("q.id").alias("id"))).alias("raw"), "q.*")
    d = d.withColumn("id", F.when(F.get_json_object("line", "$.id").rlike(r"^-?[0-9]+$") & ~F.col("line").rlike(r'"id"\s*:\s*"'), F.get_json_object("line", "$.id")).otherwise(F.regexp_extract("raw", r'^\{"id":(.*)\}$', 1)))
    d = d.withColumn("id", F.when(F.col("id") == "", None).otherwise(F.col("id")))
    text = F.col("params.arguments.text")
    call = (F.col("method") == "tools/call") & (F.col("params.name") == "lint") & F.isnotnull(text) & (F.octet_length(text) <= MOST_TEXT)
    d = d.withColumn("doc_id", F.monotonically_increasing_id()).withColumn("called", F.coalesce(call, F.lit(False)))
    plain = (
        F.when(F.octet_length("line") > MOST_BYTES, _error(BAD_REQUEST, "line too long")).when(F.isnull("method") & F.isnull("jsonrpc"), _error(PARSE_ERROR, "parse error"))
        .when(F.isnull("method"), _error(BAD_REQUEST, "invalid request")).when(F.col("method") == "initialize", _answer(F.lit('{"protocolVersion":"2024-11-05","capabilities":{"tools":{}}}')))
        .when(F.col("method").isin("ping", "shutdown"), _answer(F.lit("{}"))).when(F.col("method") == "tools/list", _answer(F.lit(f'{{"tools":{_TOOLS}}}')))
        .when(F.col("method") == "tools/call", _error(BAD_PARAMETERS, "invalid params")).otherwise(_error(NO_METHOD, "method not found"))
    )
    rest = d.where(~F.col("called") & (F.isnotnull("id") | F.isnull("method"))).select(plain.alias("line"))
    asked = d.where("called").select("doc_id", text.alias("text"), "id")
    made = scanned(asked.select("doc_id", "text", F.col("id")), profile, keep=("id",))
    content = F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), F.to_json(F.struct("issues")).alias("text"))).alias("content")))
    return rest.unionByName(made.select(_answer(content).alias("line")))
