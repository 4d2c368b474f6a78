from pyspark.sql import functions as F

from inkwell.operators import roles as R

NAMES = {
    "COR": (0.92, "acronym", "role"),
    "Employees": (0.85, "worker", "role"),
    "senior  management": (0.88, "government", "role"),
    "Graduate Student": (0.88, "academic", "role"),
    "abc": (0.0, "too short", "unknown"),
    "one two three four five six seven": (0.0, "too many words", "unknown"),
    "The Manager": (0.0, "begins like a phrase", "role"),
    "Crew that flies": (0.0, "connecting word", "unknown"),
    "Pilot and Test Director": (0.0, "two roles", "role"),
    "Check of the pump": (0.0, "the inside", "unknown"),
    "Support Services": (0.0, "ends like a phrase", "unknown"),
    "Denver Building": (0.0, "place", "unknown"),
    "Federal Building Director": (0.9, "strong suffix", "role"),
    "Own Data Group": (0.0, "of one's own", "unknown"),
    "Mission Assurance": (0.0, "known to be none", "false_positive"),
    "Flight Surgeon": (0.95, "known role", "role"),
    "Systems Engineer (SE)": (0.9, "strong suffix", "role"),
    "Mission Assurance People": (0.0, "part is known to be none", "unknown"),
    "Crew reviewed by somebody": (0.0, "phrase", "unknown"),
    "Crew reviews": (0.0, "activity", "unknown"),
    "Change Control Board": (0.9, "suffix and modifier", "role"),
    "Weather Board": (0.75, "suffix", "role"),
    "Very Old Weather Board": (0.6, "suffix of a long name", "role"),
    "council": (0.5, "suffix alone", "role"),
    "Council Member": (0.65, "suffix inside", "role"),
    "Deputy Person": (0.55, "modifier first", "role"),
    "Our Flight Surgeon": (0.7, "holds a known role", "role"),
    "Test Report": (0.55, "modifier first", "deliverable"),
    "Report Engineer": (0.0, "begins like a phrase", "role"),
    "progress": (0.0, "word that is no role", "unknown"),
    "Some body": (0.0, "begins like a phrase", "unknown"),
    "Blue Sky": (0.0, "no rule", "unknown"),
}


def test_the_first_rule_decides(spark):
    one = lambda *names: spark.createDataFrame([(n,) for n in names], "name string")
    names = one(*NAMES, "call 555-1234", "2 pilots", "Owner/Manager", "  ", "COR", "cor").unionByName(spark.createDataFrame([(None,)], "name string"))
    rows = R.valid_role_names(names, one("Flight Surgeon"), one("Mission Assurance"), one("progress", "two words")).collect()
    got = {r.name: (r.confidence, r.reason, r.kind) for r in rows}
    want = {" ".join(n.replace("(SE)", "").split()).lower(): v for n, v in NAMES.items()}
    assert got == want and len(rows) == len(want)
    assert all(r.valid == (r.confidence > 0) for r in rows)


def test_every_rule_is_tested():
    assert {r.reason for r in R.RULES} - {v[1] for v in NAMES.values()} <= {"too long", "phone number", "fragment"}


def test_names_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)
    one = lambda *names: spark.createDataFrame([(n,) for n in names], "name string")

    def seen(name):
        read.add(1)
        return name

    names = spark.range(0, 90, numPartitions=3).select(F.concat(F.lit("Chief "), F.col("id") % 3).alias("name")).select(F.udf(seen)("name").alias("name"))
    assert len(R.valid_role_names(names, one("chief 0"), one("mission assurance"), one("progress")).collect()) == 3
    assert read.value == 90
