from aktenwerk.operators import masking as m


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "document_id long, text string")


def zones(spark, text):
    return m.extract_zones(frame(spark, text)).first()


def test_names(spark):
    assert zones(spark, "Einreichende Person: Hildegard Schumacher, Weg 1")["names"] == ["Hildegard Schumacher"]
    assert zones(spark, "Von: Dr. Ralf Kern\n")["names"] == ["Ralf Kern"]
    assert zones(spark, "Einreicher: RA Prof. Dr. Eva Lang (Kanzleiinhaberin)")["names"] == ["Eva Lang"]
    assert zones(spark, "Name: Ralf Sprecher")["names"] == ["Ralf Sprecher"]
    org = zones(spark, "Einreichende Organisation: Wind AöR, vertreten durch Geschäftsführer Hans-Dieter Volz, Ort")
    assert org["names"] == ["Hans-Dieter Volz"]
    assert zones(spark, "vertreten durch den Vorsitzenden Karl Hof,\nvertreten durch: Sprecherin Ute Ohm")["names"] == ["Karl Hof", "Ute Ohm"]
    none = zones(spark, "kein Name")
    assert none["names"] == [] and none["anchor"] is None
    text = "x\nEinreicher: Eva Lang, y"
    z = zones(spark, text)
    assert text[z["anchor"]["s"] : z["anchor"]["e"]] == "Einreicher: Eva Lang"


def test_signature(spark):
    text = "Lang. " * 50 + "\n\nMit freundlichen Grüßen\nEva"
    z = zones(spark, text)["signature"]
    assert text[z["s"] : z["e"]] == "Mit freundlichen Grüßen\nEva"
    text = "Lang. " * 50 + "\n\nEva Lang\n\nPS: kurz\n"
    z = zones(spark, text)["signature"]
    assert text[z["s"] : z["e"]] == "Eva Lang\n\nPS: kurz\n"
    assert zones(spark, "Lang. " * 50)["signature"] is None and zones(spark, " \n")["signature"] is None
    blocks = "\n\n".join("kurz " * 20 for _ in range(6))
    z = zones(spark, blocks)["signature"]
    assert z["e"] - z["s"] <= 250


def test_anchor_words_only_inside_zones(spark):
    text = "Einreicher: Eva Stein, Ort\n\nDer Steinbruch und Stein bleiben hier im Text stehen. " + "Viel Text. " * 30 + "\n\nMit freundlichen Grüßen\nEva Stein"
    spans = m.anchor_spans(m.extract_zones(frame(spark, text))).collect()
    assert sorted(text[s["s"] : s["e"]] for s in spans) == ["Eva", "Eva", "Stein", "Stein"]


def test_detectors(spark):
    text = "Tel 0171 1234567, +49 30 123456, 08.11.2024, a.b@c.de, DE89 3704 0044 0532 0130 00, DE00 3704 0044 0532 0130 00"
    got = [(r["entity_type"], text[r["s"] : r["e"]]) for r in m.detect_pii(frame(spark, text)).orderBy("s").collect()]
    assert ("PHONE_NUMBER", "0171 1234567") in got and ("PHONE_NUMBER", "+49 30 123456") in got and ("EMAIL_ADDRESS", "a.b@c.de") in got
    assert [t for k, t in got if k == "IBAN_CODE"] == ["DE89 3704 0044 0532 0130 00"]
    assert not any("2024" in t for _, t in got)


def regions(spark, text, spans):
    docs = frame(spark, text)
    s = spark.createDataFrame([(0, *x) for x in spans], "document_id long, s int, e int, entity_type string, score double")
    return m.mask(m.merge_regions(docs, s)).first()


def test_regions(spark):
    r = regions(spark, "Eva Stein x", [(0, 3, "PERSON", 1.0), (4, 9, "PERSON", 0.8)])
    assert r["clean_text"] == "[NAME] x" and r["entity_counts"] == {"NAME": 1}
    r = regions(spark, "Eva Stein x", [(0, 9, "EMAIL_ADDRESS", 0.5), (4, 9, "PERSON", 1.0)])
    assert r["clean_text"] == "[NAME] x"
    r = regions(spark, "ab cd", [(0, 2, "PERSON", 1.0), (3, 5, "EMAIL_ADDRESS", 1.0)])
    assert r["clean_text"] == "[NAME] [EMAIL]" and r["entity_counts"] == {"EMAIL": 1, "NAME": 1}
    r = regions(spark, "ab cd ef", [(0, 4, "PERSON", 0.5), (3, 5, "EMAIL_ADDRESS", 0.5), (6, 8, "EMAIL_ADDRESS", 0.9)])
    assert r["clean_text"] == "[NAME] [EMAIL]"
    assert regions(spark, "leer", [])["clean_text"] == "leer"


def test_plug_in_detector(spark):
    find = m.register_detector(lambda texts: texts.map(lambda t: [(0, 3, "PERSON", 0.7)] if (t or "").startswith("Eva") else []))
    got = m.detect_pii(frame(spark, "Eva", "Udo", None), plugins=(find,)).collect()
    assert [(r["document_id"], r["e"]) for r in got] == [(0, 3)]


def test_coverage_and_evaluation(spark):
    text = "Einreicher: Eva Stein, Ort\n" + "Text. " * 60
    z = m.extract_zones(frame(spark, text))
    assert m.coverage_anomalies(m.merge_regions(z, m.detect_pii(z))).first()["survivor_count"] == 2
    assert m.coverage_anomalies(m.merge_regions(z, m.anchor_spans(z))).count() == 0
    truth = spark.createDataFrame([("a", ["Eva Stein", "Udo"], ["Steinbruch", "fehlt"])], "file string, names_must_mask array<string>, must_survive array<string>")
    masked = spark.createDataFrame([("a", "[NAME] im Steinbruch, Udo")], "file string, masked_text string")
    r = m.pii_eval(truth, masked).where("file = 'a'").first()
    assert (r["names"], r["leaked"], r["terms"], r["destroyed"], r["recall"], r["precision"]) == (2, 1, 2, 1, 0.5, 0.5)


def test_cheap_steps_find_the_same(spark):
    """Mail addresses are looked for around their signs only, words by their letters first, closings all at once."""
    from pyspark.sql import functions as F

    from aktenwerk.functions.text import last_index, occurrences

    part = m.DETECTORS["EMAIL_ADDRESS"][3]
    texts = ("wort " * 50 + "x.y@b.de, c@d.org. " + "wort " * 50, "a@b.de", "@", "ohne", "𝒳 a@b.de@c.de-")
    rows = [(t, [t[s:e] for s, e in found]) for t, found in zip(texts, ([(250, 268)], [(0, 6)], [(0, 1)], [], [(2, 14)]), strict=True)]
    d = spark.createDataFrame(rows, "text string, want array<string>").withColumn("p", part(F.col("text")))
    for r in d.withColumn("got", F.when(F.col("p").isNotNull(), F.array(F.expr("substring(text, p.s + 1, p.e - p.s)"))).otherwise(F.array())).collect():
        assert r["got"] == r["want"]
    r = spark.createDataFrame([("b ab a-a ba", "x")], "text string, none string").select(last_index(F.col("text"), "ab", "a", "q").alias("last"), last_index(F.col("none"), "ab").alias("no"), occurrences(F.col("text"), F.lit("a")).alias("w")).first()
    assert (r["last"], r["no"], [tuple(x) for x in r["w"]]) == (10, -1, [(5, 6), (7, 8)])
