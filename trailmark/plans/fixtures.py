"""Small tables that queries and their oracles share: rows once, as a frame or as SQL VALUES."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


class Fixture:
    """Rows with a Spark schema; values() gives the same rows as a SQL table expression."""

    def __init__(self, schema: str, rows: list[tuple]):
        self.schema, self.rows = schema, rows
        self.names = [f.strip().split(" ")[0] for f in schema.split(", ")]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    def values(self, name: str) -> str:
        kinds = {"long": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}
        types = [kinds.get(f.strip().split(" ")[1], "") for f in self.schema.split(", ")]

        def literal(v, kind: str) -> str:
            if v is None:
                return f"NULL::{kind}" if kind else "NULL"
            if isinstance(v, bool):
                return str(v).upper()
            if isinstance(v, (list, tuple)):
                return "[" + ", ".join(literal(x, "") for x in v) + "]"
            if isinstance(v, str):
                parts = v.replace("'", "''").split("\n")
                return "(" + " || chr(10) || ".join(f"'{p}'" for p in parts) + ")"
            return f"{v!r}::{kind}" if kind else repr(v)

        rows = ", ".join("(" + ", ".join(literal(v, k) for v, k in zip(r, types, strict=True)) + ")" for r in self.rows)
        return f"{name}({', '.join(self.names)}) AS (VALUES {rows})"


PAGES = Fixture(
    "doc string, page int, text string",
    [
        *(("manual", p, f"Field Manual Header\nApply pressure to wound {w}.\nPage {p} of 5\nxii\nKeep the limb still and the patient warm.") for p, w in enumerate(["one", "two", "three", "four", "five"], 1)),
        ("manual", 6, "CIVIL\nimmobil-\nise the limb\nContents .......... 12\n\n   spaced \t out  line  \n3 of 9\n____ sign here"),
        ("short", 1, "Field Manual Header\nonly one"),
        ("short", 2, "Field Manual Header\nonly two"),
        ("short", 3, "Field Manual Header\nonly three"),
        ("empty", 1, None),
    ],
)
HEADINGS = Fixture(
    "line string, expected string",
    [
        ("4.2 Musculoskeletal Evaluation", "4.2 Musculoskeletal Evaluation"),
        ("SECTION 3 - AIRWAY", "3 AIRWAY"),
        ("Chapter 12: Bleeding Control", "12 Bleeding Control"),
        ("3. Apply pressure", None),
        ("100.2 Too Large Number", None),
        ("2.1 lower case words in here", None),
        ("2.1 Ends With Period.", None),
        ("WARNING", None),
        ("NOTES AND WARNING", None),
        ("HEAT ILLNESS", "Heat Illness"),
        ("PATIENT'S AIRWAY-CARE & A/B", "Patient'S Airway-Care & A/B"),
        ("REVISED 2014 EDITION", None),
        ("MARCH ORDERS", None),
        ("4.2 Manual FM 3-05", None),
        ("body text of a line", None),
        ("A" * 95, None),
    ],
)
CITATIONS = Fixture(
    "prefix string, section string, page_start int, page_end int, expected string",
    [
        ("Fixture Manual", "1.1 Bleeding", 10, 10, "[Source: Fixture Manual, Section 1.1 Bleeding, p. 10]"),
        ("Fixture Manual", "Heat Illness", 2, 4, "[Source: Fixture Manual, Heat Illness, pp. 2-4]"),
        ("Fixture Manual", None, 7, 7, "[Source: Fixture Manual, p. 7]"),
        ("Fixture Manual", "", 7, 8, "[Source: Fixture Manual, pp. 7-8]"),
    ],
)
LICENCES = Fixture(
    "license string, allowed boolean",
    [("Public domain", True), ("CC0", True), ("cc-pd", True), ("CC BY 4.0", True), ("CC BY-SA 3.0", True), (" cc by-sa 2.0 ", True), ("CC BY-NC 4.0", False), ("CC BY-ND 4.0", False), ("CC BY", False), ("CC-BY 4.0", False), ("", False), (None, False), ("MIT", False)],
)
IMAGES = Fixture(
    "slug string, category_pos int, title string, width int, license string, url string",
    [
        ("ivy", 0, "File:Ivy leaf b.jpg", 1200, "CC BY 4.0", "u1"),
        ("ivy", 0, "File:Ivy leaf a.jpg", 1200, "Public domain", "u2"),
        ("ivy", 1, "File:Ivy leaf a.jpg", 1200, "Public domain", "u2"),
        ("ivy", 1, "File:Ivy berries.png", 900, "CC0", "u3"),
        ("ivy", 1, "File:Ivy stem.jpeg", 900, "CC BY-SA 4.0", "u4"),
        ("ivy", 0, "File:Ivy range map.jpg", 1200, "CC0", "u5"),
        ("ivy", 0, "File:Ivy small.jpg", 799, "CC0", "u6"),
        ("ivy", 0, "File:Ivy.svg", 1200, "CC0", "u7"),
        ("viper", 0, "File:Viper.JPG", 800, "CC BY 2.0", "u8"),
        ("viper", 0, "File:Viper nc.jpg", 800, "CC BY-NC 2.0", "u9"),
        ("viper", 1, "File:Viper head.jpg", 2000, "cc by-sa 3.0", ""),
        ("viper", 1, "File:Viper tail.jpg", None, "CC0", "u10"),
    ],
)
SAFETY = Fixture(
    "text string, expect_blocked boolean, expect_pattern string",
    [
        ("So the diagnosis is appendicitis for certain", True, "diagnosis_is"),
        ("From the swelling you have a sprain", True, "you_have_condition"),
        ("Our victim has mild confusion", True, "patient_has_grade"),
        ("Clearly this is a grade 3 sprain", True, "this_is_a_grade"),
        ("Now take 20 ml with water", True, "prescribe_take_drug"),
        ("aspirin 81 mg tablet for the adult", True, "named_drug_dose"),
        ("At night you should take something stronger", True, "you_should_take"),
        ("Looking at this, I diagnosed frostnip", True, "i_diagnose"),
        ("Mild shock is my diagnosis so far", True, "my_diagnosis"),
        ("Work out 12 mcg / kg for the child", True, "dose_per_kg"),
        ("Fentanyl lozenge of about 800 mcg", True, "drug_with_dose"),
        ("Push 2 ml slowly through the IV", True, "dose_with_route"),
        ("Look, that was a brown recluse", True, "species_id"),
        ("it's a young cougar\nby its tracks", True, "species_id"),
        ("The one on the left is probably harmless", True, "harmless_reassurance"),
        ("Boiled roots are edible", True, "edibility_advice"),
        ("The inner leaves are fine to eat", True, "edibility_advice"),
        ("If this is a cottonmouth, back away and follow the cited page.", False, None),
        ("Ask whether it is a snake or a lizard.", False, None),
        ("Strap the splint 4 inches below the knee.", False, None),
        ("Boil water for 3 minutes before use.", False, None),
        ("Carry the 20 kg litter in turns.", False, None),
        ("Write down when the tourniquet went on.\n1. Look at the limb again.\n2. Loosen nothing.", False, None),
        ("", False, None),
    ],
)
VOCABULARY = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "cover", "the", "burn", "with", "clean", "dry", "cloth", "now", "##ed", "##er", ",", ".", "menu"]
WORDPIECE = Fixture(
    "text string, ids string",
    [
        ("cover the burn", "2 4 5 6 3"),
        ("clean cloth", "2 8 10 3"),
        ("qqzq", "2 1 3"),
        ("", "2 3"),
        ("cleaned", "2 8 12 3"),
        ("dry°", "2 1 3"),
        ("b" * 210, "2 1 3"),
        ("BURN", "2 6 3"),
        ("ménu", "2 16 3"),
        ("cover\tthe\nburn", "2 4 5 6 3"),
        ("burn, dry.", "2 6 14 9 15 3"),
        ("clean–dry", "2 8 1 9 3"),
        (" ".join(["cover the burn with clean dry cloth now"] * 2), "2 4 5 6 7 8 9 10 11 4 5 6 7 8 9 3"),
    ],
)
STORE = Fixture(
    "id long, section string, page int, citation string, text string, vector array<double>",
    [
        (1, "1.1 Burns", 10, "[Source: Field Guide, Section 1.1, p. 10]", "Cool the burn under running water.", [1.0, 0.0, 0.0, 0.0]),
        (2, "2.1 Cold", 20, "[Source: Field Guide, Section 2.1, p. 20]", "Warm the hands inside dry clothing.", [0.0, 1.0, 0.0, 0.0]),
        (3, "3.1 Heat", 30, "[Source: Field Guide, Section 3.1, p. 30]", "Move everyone into the shade.", [0.0, 0.0, 1.0, 0.0]),
    ],
)
HIT_IMAGES = Fixture(
    "chunk_id long, species_slug string, ordinal int, license string, attribution string, source_url string, size int",
    [(1, "ivy", 1, "CC BY-SA 4.0", "Fixture Photographer", "http://b", 120), (1, "ivy", 0, "Public domain", "US Fish and Wildlife Service", "http://a", 110), (2, "viper", 0, "CC0", "Nobody", "http://c", 0)],
)
FACTS_OLD = Fixture("key string, value string", [("schema_version", "1"), ("chunk_count", "10"), ("embedding_dim", "4")])
FACTS_NEW = Fixture("key string, value string", [("chunk_count", "12"), ("pack_cards", "2")])
CARDS = Fixture(
    "pos int, slug string, common_name string, scientific_name string, hazard_class string, region string, identification string, lookalikes string, field_response array<string>, do_not array<string>, source_citation string",
    [
        (0, "fixture-ivy", "Fixture Ivy", "Hedera exempli", "Contact dermatitis", "Everywhere", "Three leaflets.", "", ["Wash the skin.", "Remove clothing."], [], "Manual A"),
        (1, "fixture-viper", "Fixture Viper", "Vipera exempli", "Venomous snake", "Hills", "Broad head.", "Water snake", ["Keep still."], ["Do not cut.", "Do not suck."], "Manual B"),
    ],
)
STEPS = Fixture(
    "id long, text string",
    [
        (1, "• Apply direct pressure to the wound\n2) Elevate the injured limb above the heart\nplain prose that reads on for a while\nplain prose that reads on for a while\nNote: this line is no step at all here"),
        (2, "Figure 3 shows the position of the hands\ntoo short\na) Reassess the patient every five minutes\n- Reassess the patient every five minutes\niv. Document the time of the tourniquet"),
        (3, ""),
    ],
)


def _answer(*pages: tuple[str, str, int]) -> str:
    """An image-info answer of (title, licence, source width) pages."""
    return json.dumps({"query": {"pages": [{"title": t, "imageinfo": [{"url": "full", "thumburl": "thumb", "descriptionurl": "page", "width": w, "height": 600, "thumbwidth": 640, "thumbheight": 480, "extmetadata": {"LicenseShortName": {"value": lic}, "Artist": {"value": "<b>Some  One</b>"}}}]} for t, lic, w in pages]}})


ANSWERS = Fixture(
    "slug string, category_pos int, body string",
    [
        ("ivy", 0, _answer(("File:b.jpg", "CC BY 4.0", 1200), ("File:a.png", "<i>CC0</i>", 800), ("File:a map.png", "CC0", 900), ("File:c.jpg", "CC BY-ND 4.0", 900), ("File:d.jpg", "CC0", 799))),
        ("ivy", 1, _answer(("File:b.jpg", "CC BY 4.0", 1200), ("File:e.JPEG", "Public domain", 1000), ("File:f.jpeg", "Public domain", 1000))),
        ("viper", 0, "{}"),
    ],
)
RESOLVED = Fixture(
    "slug string, ordinal int, title string, license string, attribution string, thumb_url string, width int",
    [("ivy", 0, "File:a.png", "CC0", "Some One", "thumb", 640), ("ivy", 1, "File:b.jpg", "CC BY 4.0", "Some One", "thumb", 640), ("ivy", 2, "File:e.JPEG", "Public domain", "Some One", "thumb", 640)],
)
SOURCES = Fixture(
    "filename string, title string, citation_prefix string",
    [("camp.pdf", "Camp Care", "Camp Guide"), ("river.pdf", "River Crossings", "River Guide")],
)


def _line(word: str, n: int) -> str:
    return " ".join(f"{word}{k}" for k in range(n))


#: Pages under headings: a section that ends after ten pages, two sections on one page, an end that is carried over a heading.
GUIDES = [
    ("span", ["2.1 Burn Care\n" + _line("a", 60), *[""] * 9, _line("b", 60), _line("c", 60) + "\n" + _line("d", 60)]),
    ("two", ["2.1 Burn Care\n" + _line("a", 60) + "\n2.2 Cold Injury\n" + _line("b", 60), _line("c", 40)]),
    ("carry", ["2.1 Burn Care\n" + _line("a", 30) + "\n2.2 Cold Injury", _line("b", 30)]),
    ("none", []),
]
GUIDE_CHUNKS = Fixture(
    "doc string, seq int, text string, section string, page_start int, page_end int, token_count int",
    [
        ("span", 0, "\n".join(_line(w, 60) for w in "abc"), "2.1 Burn Care", 1, 12, 180),
        ("span", 1, _line("d", 60), None, 12, 12, 60),
        ("two", 0, _line("a", 60), "2.1 Burn Care", 1, 1, 60),
        ("two", 1, _line("b", 60) + "\n" + _line("c", 40), "2.2 Cold Injury", 1, 2, 100),
        ("carry", 0, _line("a", 30), "2.1 Burn Care", 1, 1, 30),
        ("carry", 1, _line("a", 30) + "\n" + _line("b", 30), "2.1 Burn Care", 1, 2, 60),
    ],
)
