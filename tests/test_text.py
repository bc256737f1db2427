"""Text functions on given values."""

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import text as t


@pytest.mark.parametrize(
    ("word", "stem"),
    [("retries", "retry"), ("retried", "retry"), ("retrying", "retry"), ("payments", "payment"), ("validating", "validate"), ("validation", "validate"), ("connections", "connect"), ("configuring", "config"),
     ("parsing", "parse"), ("parser", "parse"), ("parsers", "parse"), ("watches", "watch"), ("status", "status"), ("class", "class"), ("running", "run"), ("processing", "process"), ("the", "the")],
)
def test_stem(spark, word, stem):
    assert spark.range(1).select(t.stem(F.lit(word))).first()[0] == stem


@pytest.mark.parametrize(
    ("raw", "route"),
    [("/api/users/{user_id}", "/api/users/:param"), ("/api/users/:userId", "/api/users/:param"), ("/api/users/${id}", "/api/users/:param"), ("/api/users/<int:user_id>", "/api/users/:param"),
     ("/api/users/98765", "/api/users/:param"), ("", "/"), ("${this.apiUrl}/users", "/users"), ("${BASE}auth/login", "/auth/login"), ("https://h.example/A/b?x=1#y", "/a/b"), ("https://h.example", "/")],
)
def test_route(spark, raw, route):
    assert spark.range(1).select(t.normalize_route(F.lit(raw))).first()[0] == route


@pytest.mark.parametrize(
    ("client", "server", "match"),
    [("/api/users/:param", "/api/users/:param", True), ("/users/7a", "/users/:param", True), ("/v1/api/users", "/api/users", True), ("/users", "/api/users", False), ("/:param", "/users", False),
     ("/a/b", "/c/d", False), ("/", "/", False)],
)
def test_match(spark, client, server, match):
    assert spark.range(1).select(t.routes_match(F.lit(client), F.lit(server))).first()[0] is match


def test_tokens(spark):
    got = spark.createDataFrame([("",), ("one two three",), ("x" * 40,)], "s string").select(t.token_estimate(F.col("s"))).collect()
    assert [r[0] for r in got] == [0, 3, 10]
