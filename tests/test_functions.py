import pytest
from pyspark.sql import functions as F

from pricelake.functions import money, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def answers(spark, f, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("f", "cases"),
    [
        (money.parse_price, {"£1,234.00": 1234.0, "£950": 950.0, "From £2,499.99": 2499.99, "1.234,56": 1234.56, "£1,234": 1.23, "12,950": 12.95, "POA": None, "": None, None: None, "1 234.5": 1234.5}),
        (money.feed_price, {"1900.0 GBP": 1900.0, "1,250.50 GBP": 1250.5, "1900": 1900.0, "": None, "POA": None, "1.2.3": 1.2, None: None}),
        (money.feed_currency, {"1900.0 gbp": "GBP", "1900": None, "POA": None}),
        (text.normalise_text, {"Rock & Roll’s  ": "rock and roll s", "A-B.c/Ü": "a-b.c"}),
        (text.case_size, {"41mm": "41", "40.5 MM": "40.5", "39": "39", "big": None}),
        (text.carat, {"0.50ct": "0.5", "1/2 carat": "0.5", "1.00 ct": "1", "18ct White Gold 0.50ct": "18", "x": None}),
        (text.damaged_identifier, {"7.32E+11": True, "4.50013E+11": True, "5E+12": True, "7320000000123": False, "6161 WG": False, "M116503-0001": False, "": False}),
        (text.slug_words, {"https://x.co/uk/Rolex-Cosmograph-Daytona-M116503-0001/p/123?a=b": "uk rolex cosmograph daytona m116503 0001 p 123", "https://x.co/mappin%20%26%20webb/ring": "mappin webb ring", "not a url": "not a url"}),
        (text.category_of, {"Earrings": "ring", "Watch winders": "accessory", "watches": "watch", None: "default", "Vase": "default"}),
        (text.availability, {"In Stock": True, "Sold out": False, "Ask": None, None: None}),
    ],
)
def test_scalar_functions(spark, f, cases):
    assert answers(spark, f, list(cases)) == list(cases.values())


def test_positions_and_deltas(spark):
    rows = spark.createDataFrame([(100.0, 120.0), (120.0, 100.0), (100.0, 100.0), (100.001, 100.0), (5.0, 0.0), (None, 1.0), (99.995, 100.0)], "a double, b double")
    got = rows.select(money.classify_position(F.col("a"), F.col("b")), money.delta_abs(F.col("a"), F.col("b")), money.delta_pct(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got[:2]] == [("lower", -20.0, -16.67), ("higher", 20.0, 20.0)]
    assert [r[0] for r in got[2:]] == ["equal", "equal", "higher", None, "equal"]
    assert got[4][2] is None and got[5][1] is None
    assert one(spark, money.round2(F.lit(-0.025))) == -0.02


def test_sale_windows(spark):
    now = F.lit("2026-08-09T12:00:00Z").cast("timestamp")
    cases = {None: True, "": True, "2026-08-01T00:00Z/2026-08-31T00:00Z": True, "2026-09-01T00:00Z/2026-09-30T00:00Z": False, "2026-01-01T00:00Z/2026-02-01T00:00Z": False, "junk": True, "/2026-08-01T00:00Z": False, "2026-08-09T08:00:00-03:00/": True, "2026-08-09T12:00:00Z/2026-08-09T12:00:00Z": True}
    assert answers(spark, lambda x: money.sale_window_open(x, now), list(cases)) == list(cases.values())


def test_search_terms(spark):
    got = one(spark, text.search_terms(F.lit("Rolex"), F.lit("Cosmograph Daytona the watch 41mm of gold in it is up"), F.lit(" M116503-0001 ")))
    assert got == ["cosmograph", "daytona", "m116503", "rolex", "41mm", "0001", "of", "in"]
    assert one(spark, text.search_terms(F.lit("p"), F.lit("the ring"), F.lit(None).cast("string"))) == []


def test_file_and_image_kinds(spark):
    kinds = lambda f, xs: [one(spark, f(F.lit(bytearray(x)))) for x in xs]
    assert kinds(text.detect_format, [b"PK\x03\x04", bytes.fromhex("D0CF11E0A1B11AE1"), b"  <html>", b"a,b"]) == ["xlsx", "legacy-xls", "html", "text"]
    images = [b"\x89PNG\r\n", b"GIF89a", b"\xff\xd8\xff", b"RIFF\0\0\0\0WEBP", b"\0\0\1\0", b" <svg>", b"<?xml ?><svg>", b"text", b""]
    assert kinds(text.image_type, images) == ["image/png", "image/gif", "image/jpeg", "image/webp", "image/x-icon", "image/svg+xml", "image/svg+xml", None, None]


def test_logo_marks(spark):
    assert answers(spark, text.initials, ["Ernest Jones", "Fraser Hart", "Beaverbrooks", "77 Diamonds", "Berry's Jewellers", "Hatton-Selby", ""]) == ["EJ", "FH", "B", "7D", "BJ", "HS", "?"]
    hues = answers(spark, text.hue, ["ernest-jones", "h-samuel", "ernest-jones", ""])
    assert hues[0] == hues[2] and all(190 <= h <= 330 for h in hues)


def test_text_supports(spark):
    cases = [("case 39 mm steel", "case_size", "39", False), ("case 40.5 mm steel", "case_size", "40.5", True), ("x140.5mm", "case_size", "40.5", False), ("blue dial", "dial_colour", "blue", True), ("a b", "model", "a", False), ("x", "model", None, False)]
    rows = spark.createDataFrame(cases, "h string, a string, v string, want boolean")
    assert all(r.got == r.want for r in rows.select("want", text.text_supports(F.col("h"), F.col("a"), F.col("v")).alias("got")).collect())


def test_specs_and_search_terms(spark):
    rows = spark.createDataFrame([({"Ref": " M1 ", "zz reference": "x"}, "Rolex", "Daytona"), ({"reference": "  "}, "Rolex", "Daytona"), (None, "Rolex", "Daytona")], "s map<string,string>, b string, n string")
    got = [r[0] for r in rows.select(text.search_term(F.col("b"), F.col("n"), F.col("s"))).collect()]
    assert got == ["Rolex M1", "Rolex Daytona", "Rolex Daytona"]
    items = spark.createDataFrame([(2, 1, 4, None, None), (0, 0, 4, "u", "why"), (0, 0, 4, None, None)], "a int, b int, c int, u string, w string")
    said = [r[0] for r in items.select(text.run_item_detail(*[F.col(c) for c in "abcuw"])).collect()]
    assert "2" in said[0] and "u" in said[1] and "why" in said[1] and "none" in said[2]


def test_labels(spark):
    from pricelake.functions import labels

    money_ = spark.createDataFrame([(1234.5, "GBP"), (-2.0, "EUR"), (None, "GBP"), (1.0, "CHF")], "x double, c string")
    assert [r[0] for r in money_.select(labels.money_text(F.col("x"), F.col("c"))).collect()] == ["£1,234.50", "-€2.00", "—", "CHF\u00a01.00"]
    share = spark.createDataFrame([(1.25,), (-3.0,), (0.0,), (None,)], "x double")
    assert [r[0] for r in share.select(labels.percent_text(F.col("x"))).collect()][1:] == ["-3.0%", "0.0%", "—"]
    assert answers(spark, labels.tier_label, ["manual", "new"]) == ["Manually linked", "new"]
    assert answers(spark, labels.error_label, ["timeout"]) == ["Timed out"] and answers(spark, labels.mode_label, ["both"])[0].startswith("Look")
    assert answers(spark, labels.host_of, ["https://A.co:8080/x?y", "nothing"]) == ["a.co:8080", "nothing"]
    hues = answers(spark, labels.brand_hue, ["Rolex", "Omega", "Rolex", ""])

    def hue(brand):
        h = 0
        for c in brand:
            h = (h * 31 + ord(c)) % 2**32
        return [265, 200, 158, 32, 340, 12, 190, 95][h % 8]

    assert hues == [hue(b) for b in ("Rolex", "Omega", "Rolex", "")]
    now = F.lit("2026-08-09 12:00:00").cast("timestamp")
    times = {"2026-08-09 11:59:40": "just now", "2026-08-09 11:20:00": "40m ago", "2026-08-09 02:00:00": "10h ago", "2026-08-01 12:00:00": "8d ago", None: "never"}
    assert answers(spark, lambda x: labels.relative_time(x.cast("timestamp"), now), list(times)) == list(times.values())
    assert answers(spark, lambda x: labels.day_text(x.cast("timestamp")), ["2026-08-09 11:05:00", None]) == ["09 Aug, 11:05", "—"]
