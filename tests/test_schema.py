import pytest
from pyspark.sql import types as T

from flowprep.functions import schema as S


@pytest.mark.parametrize(
    ("raw", "name"),
    [
        ("a_-b", "a_b"), ("Src_/Dst", "src_dst"), ("__x--y..z__", "x_y_z"), ("Rate (kB/s)", "rate_kb_s"), ("TotalLenOfTCP", "total_len_of_tcp"), ("HTTPServer2Port", "http_server2_port"),
        ("HTTPServer port", "httpserver_port"), ("x1Y", "x1_y"), ("ABC", "abc"), ("aBC", "a_bc"), ("", ""), (" - ", ""), ("\ufeffClass", "class"), ("ｆｕｌｌ Ｗidth", "full_width"), ("caféBar", "caf_bar"), ("tab\tbedName", "tab_bedname"), ("1st#2nd", "1st_2nd"),
    ],
)
def test_normal_name(raw, name):
    assert S.normal_name(raw) == name


def test_normal_names_are_their_own():
    """A normal name has no other one, whatever signs stood between its words."""
    import itertools

    for signs in itertools.product(["_", "-", "/", "__", "_-", " _ ", ".-_"], repeat=2):
        name = S.normal_name(f"one{signs[0]}two{signs[1]}three")
        assert name == "one_two_three" == S.normal_name(name)


def test_rates_are_not_doubled():
    assert S.rate_spellings("packets_s") == {"packets_s", "packets_per_s"}
    assert S.rate_spellings("packets_per_s") == {"packets_per_s"}
    assert S.rate_spellings("packets") == {"packets"}
    assert S.alias_index({"a_per_s": [], "a_s_total": ["A/s total"]})


def test_aliases():
    index = S.alias_index({"flow_bytes_per_s": ["Flow Byts/s", "Flow Bytes/s"], "label": ["Class"]})
    assert S.resolve(" Flow Byts/s", index) == "flow_bytes_per_s"
    with pytest.raises(S.AmbiguousAlias):
        S.alias_index({"a": ["x"], "b": ["X"]})


def test_clashes_are_reported(spark):
    _, clashes = S.column_mapping(["Dst Port", "DstPort"], {})
    assert clashes == {"dst_port": ["Dst Port", "DstPort"]}
    with pytest.raises(ValueError, match="share a name"):
        S.canonical(spark.createDataFrame([(1, 2)], "`Dst Port` int, DstPort int"), {})


def test_label_and_features():
    assert S.label_column(["a", " Label"], ["label", "class"]) == " Label"
    with pytest.raises(KeyError):
        S.label_column(["a"], ["label"])
    schema = T.StructType([T.StructField("Flow ID", T.StringType()), T.StructField("x", T.DoubleType()), T.StructField("b", T.BooleanType()), T.StructField("Src Port", T.IntegerType())])
    assert S.feature_columns(schema, ["src_port"]) == (["x", "b"], ["Src Port"], ["Flow ID"])
    assert S.pick(["A b", "c"], "a_b") == "A b"


def test_feature_hash_depends_on_order():
    assert S.feature_hash(["a", "b"]) != S.feature_hash(["b", "a"])
    assert S.schema_difference(["a", "b"], ["b", "c"]) == (["a"], ["c"])
