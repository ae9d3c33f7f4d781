"""Functions for SQL: register(spark) makes them known to a session. They are expressions, not Python."""

from pyspark.sql import SparkSession

FUNCTIONS = {
    "cadenza_mirex(gold_tonic int, gold_minor boolean, tonic int, minor boolean) returns double": """case
 when gold_minor = minor and tonic = gold_tonic then 1D when gold_minor = minor and pmod(tonic - gold_tonic, 12) in (5, 7) then 0.5D
 when gold_minor <> minor and pmod(tonic - gold_tonic, 12) = if(gold_minor, 3, 9) then 0.3D when gold_minor <> minor and tonic = gold_tonic then 0.2D else 0D end""",
    "cadenza_chord_root(chord string) returns string": "regexp_extract(split_part(chord, '/', 1), '^([CDEFGA]#|[CDEFGAB]b|[A-G])', 1)",
    "cadenza_monophonic(onsets array<struct<bar: int, shift: int>>) returns boolean": "size(array_distinct(onsets)) = size(onsets)",
    "cadenza_measures(tokens array<int>) returns int": "size(filter(tokens, x -> x = 49))",
}


def register(spark: SparkSession) -> None:
    for head, body in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {head} return {body}")
