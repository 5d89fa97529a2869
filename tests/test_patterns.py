"""Users' patterns: RE2's meaning in Java's dialect, by DuckDB, whose engine is RE2."""
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewater.functions.patterns import ignoring_case, re2_to_java
from tidewater.operators import alerts, live
from tidewater.plans import history
from tidewater.schemas import RULES

PATTERNS = [
    r"(?P<x>boom)", r"[[:digit:]]+$", r"[^[:alpha:]]", r"[[:^digit:]x]", r"\pL+", r"\p{Greek}", r"\P{L}", r"\p{^Lu}", r"[\pN&&[a]", r"^a.c$", r"(?m)^b$", r"(?s)a.c", "(?ms)^.c",
    r"\bfoo\b", r"\Boo", r"a{,3}", r"x{2,3}?y", r"(?U)a+b", r"\QA.B\E+", r"\x41\x{3b1}\101", r"[]a]", r"[^]a]", r"[a\-z]", r"[\s]", r"[\S]b", r"[^\S]", r"\v", r"\a|\f", r"(?i)STRASSE|É", r"(?i:a)B", r"a|(?i)b|c",
    r"[[:word:]]{3}", r"[[:space:]]", r"\d\D\w\W", r"(|a)*b", r"\z", r"\Aab", r"a{2}", r"[a-c-e]", r"[+--]", "\\.", r"{", r"}", "a{1", r"(?-i)a", r"[[:punct:]]",
]
INVALID = ["(", ")", "*a", "a**", "a++", "a{2}{3}", "x{1001}", "x{3,2}", r"\1", r"\k<x>", "(?=a)", "(?<!a)", "(?>a)", r"\Z", r"\h", r"[a-\d]", "[z-a]", "[a", "[[:nope:]]", r"(?P<x>a)(?P<x>b)", "(?P<>a)", r"\p{Nope}",
           "(?z)a", "\\", r"\x{110000}", "(?"]
TEXTS = ["", "boom", "boom 123", "123\n", "aαb", "Ω", "abc", "a\nc", "x\nb\ny", "foo bar", "food", "a{,3}", "xxxy", "aaab", "A.BBB", "Aα!", "]", "a-z", " ", "\x0b", "\x07 \x0c", "straße STRASSE é", "aB AB", "C",
         "b", "c", "A&&[", "12 a_ -", "a\r\nb", " ", "a{1 {}", "+,-."]


def test_meaning_is_re2s(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    got = d.select("i", *[F.col("t").rlike(re2_to_java(p)).alias(f"p{k}") for k, p in enumerate(PATTERNS)]).orderBy("i").collect()
    con = duckdb.connect()
    for k, p in enumerate(PATTERNS):
        want = [con.execute("SELECT regexp_matches(?, ?)", [t, p]).fetchone()[0] for t in TEXTS]
        assert [r[f"p{k}"] for r in got] == want, p
    con.close()


def test_random_patterns(spark):
    rng = random.Random(3)
    parts = ["a", "b", ".", "[ab]", "[^a]", "(a|b)", "(?:b)", "a*", "b+?", "a?", "^", "$", r"\b", r"\s", "(?i:A)", "[[:alpha:]]", r"\pL", "a{1,2}", "\\n", "(?m:^)", "(?s:.)"]
    patterns, texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for _ in range(60)], ["".join(rng.choice("abA \n1") for _ in range(rng.randint(0, 6))) for _ in range(60)]
    con = duckdb.connect()
    good = []
    for p in patterns:
        try:
            con.execute("SELECT regexp_matches('a', ?)", [p])
            good.append(p)
        except duckdb.Error:
            pass
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = d.select("i", *[F.col("t").rlike(re2_to_java(p)).alias(f"p{k}") for k, p in enumerate(good)]).orderBy("i").collect()
    for k, p in enumerate(good):
        assert [r[f"p{k}"] for r in got] == [con.execute("SELECT regexp_matches(?, ?)", [t, p]).fetchone()[0] for t in texts], p
    con.close()


def test_what_re2_lacks_is_refused(spark):
    for p in INVALID:
        with pytest.raises(ValueError):
            re2_to_java(p)
    assert live.exclude("(")._jc.toString() == "true"
    with pytest.raises(ValueError):
        history.matches(history.HistoryQuery("n", search="(", regex=True))
    assert ignoring_case("É+") == "(?iu)É+"


def rule(i, pattern, **more):
    r = dict(id=f"r{i}", name=f"n{i}", enabled=True, type="log", hosts=[], containers=[], projects=[], events=[], min_level="", pattern=pattern, threshold=1, window_s=60, cooldown_s=0) | more
    return tuple(r.values())


def test_one_bad_rule_stops_no_other(spark):
    rules = spark.createDataFrame([rule(1, "boom"), rule(2, "("), rule(3, "(?P<x>boom)"), rule(4, r"[[:digit:]]+$"), rule(5, "", min_level="ERROR", hosts=["h2"]), rule(6, "(", enabled=False),
                                   rule(7, "", projects=["p"], containers=["z"])], RULES)
    lines = spark.createDataFrame([("h1", "c", {}, "ERROR", "boom 12", "x boom 12"), ("h2", "z", {"com.docker.compose.project": "p"}, "FATAL", "quiet", "quiet"), ("h2", "d", {}, "UNKNOWN", None, "boom")],
                                  "host string, container_name string, labels map<string,string>, level string, message string, raw string")
    got = alerts.log_matches(rules, lines)
    assert sorted((r.rule_id, r.container_name) for r in got.collect()) == [("r1", "c"), ("r1", "d"), ("r3", "c"), ("r3", "d"), ("r4", "c"), ("r5", "z"), ("r7", "z")]
    assert [r.rule_id for r in alerts.rejected_rules(rules).collect()] == ["r2"]
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert alerts.log_matches(rules.limit(0), lines).count() == 0
    with pytest.raises(ValueError):
        alerts.check_rules([dict(name="x", pattern="(?=a)")])
