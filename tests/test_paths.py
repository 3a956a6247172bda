import pytest
from pyspark.sql import functions as F

from thicket.functions import paths as p

# pattern, substring, candidate, whether it matches
CASES = [
    ("FixtureBucket/Describe", False, "FixtureBucket/Describe", True),
    ("FixtureBucket/Describe", False, "pkg/FixtureBucket/Describe", True),
    ("FixtureBucket/Describe", False, "FixtureBucket/Describe@19:4", True),
    ("FixtureBucket/Describe", False, "FixtureBucket/MeasureDepth", False),
    ("/FixtureBucket/Describe", False, "FixtureBucket/Describe", True),
    ("/FixtureBucket/Describe", False, "FixtureBucket/Describe@19:4", True),
    ("/FixtureBucket/Describe", False, "pkg/FixtureBucket/Describe", False),
    ("/FixtureBucket/Describe@19:4", False, "FixtureBucket/Describe@19:4", True),
    ("/FixtureBucket/Describe@19:4", False, "FixtureBucket/Describe@20:4", False),
    ("FixtureBucket/Desc", True, "FixtureBucket/Describe", True),
    ("FixtureBucket/Desc", True, "FixtureBucket/Describe@19:4", True),
    ("FixtureBucket/Desc", True, "FixtureBucket/MeasureDepth", False),
    ("//", False, "anything", False),
    ("A/x", True, "a/xy", False),
    ("x@1:2", True, "ax@1:2", True),
    ("a@b", False, "a@b@1:2", True),
]


def test_patterns_on_the_driver():
    for pattern, sub, path, want in CASES:
        assert p.Pattern.parse(pattern, sub).matches(path) is want, (pattern, path)


def test_patterns_as_predicates(spark):
    for pattern, sub, path, want in CASES:
        df = spark.createDataFrame([(path.split("/"),)], "components array<string>")
        df = df.withColumns({"bases": F.transform("components", p.base_of), "leaf_base": p.base_of(F.element_at("components", -1))})
        assert df.where(p.Pattern.parse(pattern, sub).predicate()).count() == want, (pattern, path)


@pytest.mark.parametrize("text,base,mark", [("a@1:2", "a", "1:2"), ("a@b@1:2", "a@b", "1:2"), ("x@:4", "x@:4", ""), ("@1:2", "@1:2", ""), ("a@1:2x", "a@1:2x", "")])
def test_discriminators(text, base, mark):
    assert p.split_discriminator(text) == (base, mark)


def test_go_paths():
    assert p.go_path("", "(*FixtureBucket[T]).MeasureDepth") == "FixtureBucket/MeasureDepth"
    assert p.go_path("", "MakeBucket") == "MakeBucket"
    assert p.go_path("P", "T.M") == "P/M"
    assert p.go_path("", "pkg.lower") == "pkg.lower"


@pytest.mark.parametrize("query,want", [
    ("basic/MakeBucket", "MakeBucket"), ("basic.MakeBucket", "MakeBucket"), ("basic.FixtureBucket/Describe", "FixtureBucket/Describe"), ("/basic/MakeBucket", "/basic/MakeBucket"),
])
def test_go_queries(query, want):
    assert p.go_query(query) == want


def test_rust_queries():
    assert p.rust_query("Bucket/describe") == "impl Bucket/describe"
    assert p.rust_query("module/Bucket/describe") == "module/impl Bucket/describe"
    assert p.rust_query("impl Bucket/describe") is None
    assert p.rust_query("describe") is None


def test_columns(spark):
    df = spark.createDataFrame([("X/a/b", "impl A/impl B/impl C", "dir/.gitignore", 3, 5, 0)], "path string, rust string, file string, s int, e int, c int")
    r = df.select(
        p.leaf_of(F.col("path")).alias("leaf"), p.parent_of(F.col("path")).alias("parent"), p.rust_export(F.col("rust")).alias("rust"), p.extension(F.col("file")).alias("ext"),
        p.last_line(F.col("s"), F.col("e"), F.col("c")).alias("last"), p.range_text(F.lit(3), F.lit(3)).alias("one"), p.range_text(F.lit(3), F.lit(4)).alias("two"),
        p.alias_pattern("DEF", F.lit("defaultBucket"), True).alias("alias"), p.constant_pattern("DEF", F.lit("default"), True).alias("const"), p.stem(F.lit("a/imports.d.ts")).alias("stem"),
    ).first()
    assert (r.leaf, r.parent, r.rust, r.ext, r.last, r.one, r.two) == ("b", "X/a", "A/B/impl C", ".gitignore", 4, "3", "3-4")
    assert (r.alias, r.const, r.stem) == (True, False, "imports.d")
    assert p.property_target("Service@18:0/commissionTopic@37:4") == "commissionTopic"
