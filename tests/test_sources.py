import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tablehaul import sinks
from tablehaul.operators import catalog, decision, memory
from tablehaul.sources import delimited, markup, metadata, preference, tables, workbook


def write(folder, name, content):
    path = folder / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def test_dictionaries_with_different_headers(spark, tmp_path):
    write(tmp_path, "a.csv", 'table name,field name,data type,field text,length,is key,# of occ,from total\nSHIP,HARBOUR,Code,"Harbour, home",0012,x,,\n,,,,,,,\n'
          'SHIP,DRAUGHT,Decimal,Draught in metres,7,,3,9\nSHIP,,Text,nameless,4,,,\nSHIP,CREW,Crew,Crew,00,X,,\nSHIP,MASTER,,Name of the master,120,,,\n')
    write(tmp_path, "b.csv", "Is Key , FIELD NAME,remarks,Length\nX,BERTH,quay side,9m\n")
    write(tmp_path, "c.csv", "moon,tide\nfull,spring\n")
    rows = delimited.read_dictionary(spark, str(tmp_path)).collect()
    a = {r.field_name: (r.ordinal, r.description, r.length, r.is_key, r.nullable) for r in rows if r.file.endswith("a.csv")}
    assert a == {
        "HARBOUR": (1, "Code (Harbour, home)", 12, True, False), "DRAUGHT": (2, "Decimal (Draught in metres)", 7, False, True),
        "CREW": (3, "Crew", 0, True, False), "MASTER": (4, "Name of the master", 120, False, True),
    }
    assert [(r.field_name, r.length, r.is_key) for r in rows if r.file.endswith("b.csv")] == [("BERTH", None, True)]
    assert not [r for r in rows if r.file.endswith("c.csv")]


def test_raw_table_and_template(spark, tmp_path):
    path = write(tmp_path, "raw.csv", 'A,B\n" x ",\n"say ""hi""",NA\n')
    assert [tuple(r) for r in tables.read_raw_csv(spark, path).collect()] == [("x", ""), ('say "hi"', "NA")]
    template = write(tmp_path, "t.csv", "BANKS(k/*),BANKA(*),PROVZ\n")
    assert tables.read_template(spark, template) == ["BANKS(k/*)", "BANKA(*)", "PROVZ"]


SHEET = """<?xml version="1.0"?>
<Workbook xmlns="urn:schemas-microsoft-com:office:spreadsheet" xmlns:ss="urn:schemas-microsoft-com:office:spreadsheet">
 <Worksheet ss:Name="Intro"><Table><Row><Cell><Data ss:Type="String">Sheet Name</Data></Cell></Row></Table></Worksheet>
 <Worksheet ss:Name="Field List"><Table>
  <Row><Cell ss:Index="2"><Data ss:Type="String">Title</Data></Cell></Row>
  <Row>{header}</Row>
  <Row><Cell ss:Index="2" ss:MergeDown="3"/><Cell ss:MergeDown="1"><Data ss:Type="String">Key</Data></Cell><Cell><Data ss:Type="String">Country</Data></Cell>
   <Cell><Data ss:Type="String">mandatory for sheet</Data></Cell><Cell><Data ss:Type="String">Text</Data></Cell><Cell><Data ss:Type="String">80    </Data></Cell>
   <Cell><Data ss:Type="String"></Data></Cell><Cell><Data ss:Type="String">S_BNKA</Data></Cell><Cell><Data ss:Type="String">BANKS</Data></Cell></Row>
  <Row><Cell ss:Index="4"><Data ss:Type="String">Bank Key</Data></Cell><Cell ss:Index="9"><Data ss:Type="String">S_bnka</Data></Cell><Cell><Data ss:Type="String">BANKL</Data></Cell></Row>
  <Row/>
  <Row><Cell ss:Index="3"><Data ss:Type="String">Address</Data></Cell><Cell ss:Index="9"><Data ss:Type="String">S_OTHER</Data></Cell><Cell><Data ss:Type="String">NOPE</Data></Cell></Row>
  <Row><Cell ss:Index="5"><Data ss:Type="String">X</Data></Cell><Cell ss:Index="8"><Data ss:Type="Number">2</Data></Cell><Cell><Data ss:Type="String">S_BNKA</Data></Cell><Cell><Data ss:Type="String">AMT</Data></Cell></Row>
 </Table></Worksheet>
</Workbook>"""
HEADS = ["Sheet Name", "Group Name", "Field Description", "Importance", "Type", "Length", "Decimal", "SAP Structure", "SAP Field"]
HEADER = "".join(f'<Cell{" ss:Index=" + chr(34) + "2" + chr(34) if i == 0 else ""}><Data ss:Type="String">{h}</Data></Cell>' for i, h in enumerate(HEADS))


@pytest.mark.parametrize("repair", [False, True])
def test_markup_dictionary(spark, tmp_path, repair):
    body = SHEET.format(header=HEADER)
    if repair:
        body = body.replace("<Row/>", "<!-- note -->\x07<Row/><invalid x>&nbsp;")
    path = write(tmp_path, "d.xml", body)
    grid = markup.carry_merged(markup.read_markup_cells(spark, path, repair=repair), 15)
    rows = markup.target_dictionary(grid, F.lit("bnka")).orderBy("ordinal").collect()
    got = [(r.ordinal, r.field_name, r.field_group, r.is_key, r.is_mandatory, r.length, r.decimal, r.sheet, r.table) for r in rows]
    assert got == [
        (1, "banks", "key", True, True, 80, None, "Field List", "bnka"), (2, "bankl", "key", True, False, None, None, "Field List", "bnka"),
        (3, "amt", "", False, True, None, 2, "Field List", "bnka"),
    ]


def test_located_dictionary(spark, tmp_path):
    path = write(tmp_path, "d.xml", SHEET.format(header=HEADER.replace("SAP Field", "SAP Field (name)").replace("Length", "max length")))
    rows = markup.located_dictionary(markup.carry_merged(markup.read_markup_cells(spark, path), 15)).orderBy("row_no").collect()
    assert [(r.field, r.internal_id, r.transformer_id) for r in rows][0] == ("BANKS", "BNKA.BANKS", "S_BNKA#BANKS")
    assert [r.length for r in rows][0] == "80" and len(rows) == 4


def test_repair_expressions(frame):
    df = frame([("a<!-- x\ny -->b\x01c &amp; <Cell a=1 &b=2>t</invalid>",)], "raw string")
    assert df.select(markup.repair_markup(F.col("raw"))).first()[0] == "abc  <Cell a=1 >t"


def xlsx(path, sheets):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    shared: list[str] = []

    def cell(ref, v):
        if isinstance(v, str):
            shared.append(v)
            return f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>'
        return f'<c r="{ref}"><v>{v}</v></c>'

    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(
                f'<row r="{n}">' + "".join(cell(f"{chr(65 + c)}{n}", v) for c, v in enumerate(row) if v is not None) + "</row>"
                for n, row in rows
            )
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
        items = "".join(f"<si><t>{s}</t></si>" for s in shared)
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">{items}</sst>')


def test_workbooks(spark, tmp_path):
    xlsx(tmp_path / "a.xlsx", {"Empty": [(1, [" "])], "Data": [(2, ["NAME", None, "CITY "]), (3, [None, "z", "Rome"]), (5, ["n1", None, 7])]})
    xlsx(tmp_path / "b.xlsx", {"Only": [(1, ["ID"])]})
    rows = workbook.first_filled_sheet(workbook.read_workbooks(spark, str(tmp_path)))
    cells = {(r.row_no, r.field_name): r.value for r in workbook.long_cells(rows).collect()}
    assert cells == {(3, "NAME"): "", (3, "CITY"): "Rome", (5, "NAME"): "n1", (5, "CITY"): "7"}
    entries = {r.field_name: (r.ordinal, r.example, r.nullable) for r in workbook.workbook_catalogue(rows).collect()}
    assert entries == {"NAME": (1, "n1", True), "CITY": (3, "Rome", False)}


def test_alias_dictionary(spark, tmp_path):
    xlsx(tmp_path / "a.xlsx", {"Field List": [(1, ["FIELD", "Description", "Mandatory", "Group", "Length", "Decimals"]), (2, ["BANKS", "Country", "Yes", "KEY", 3.0, "None"]), (3, ["BANKL", "Key", "no", None, "x", 2])]})
    xlsx(tmp_path / "b.xlsx", {"S": [(1, ["foo"]), (2, ["bar"])]})
    rows = workbook.first_filled_sheet(workbook.read_workbooks(spark, str(tmp_path)))
    got = [(r.field_name, r.description, r.table, r.is_mandatory, r.is_key, r.field_group, r.length, r.decimal, r.data_type)
           for r in workbook.alias_dictionary(rows, F.lit("bnka")).orderBy("row_no").collect()]
    assert got == [("BANKS", "Country", "bnka", True, True, "key", "3", None, "Text"), ("BANKL", "Key", "bnka", False, False, "default", "x", "2", "Text")]
    assert [r.file.endswith("b.xlsx") for r in workbook.unusable_files(rows).collect()] == [True]


def test_format_preference(spark, tmp_path):
    for name in ("m1_bnka.xlsx", "m1_bnka.xml", "m2_cepc.xlsx", "m3_x.txt"):
        write(tmp_path, name, "x")
    chosen = preference.prefer(preference.list_files(spark, str(tmp_path)), preference.DICTIONARY_FORMATS)
    assert {(r.object, r.variant, r.format) for r in chosen.collect()} == {("m1", "bnka", "xml"), ("m2", "cepc", "xlsx")}


def test_format_preference_with_underscores(spark, frame, tmp_path):
    for name in ("a_b_variant.xml", "a_b_variant.xlsx", "a_c_d.xml", "z_z.xml"):
        write(tmp_path, name, "x")
    known = frame([("a_b", "variant"), ("a", "c_d"), ("q", "q")], "object string, variant string")
    chosen = preference.prefer(preference.list_files(spark, str(tmp_path), known), preference.DICTIONARY_FORMATS)
    assert {(r.object, r.variant, r.format) for r in chosen.collect()} == {("a_b", "variant", "xml"), ("a", "c_d", "xml")}


def test_contained_texts_match_a_loop(frame):
    texts = ["shipping date", "date", "da", "order number", "ab", "", None, "a date of order"]
    needles = ["date", "a", "da", "order number", "xyz", "ord", "e o", "", None]
    found = memory.containing(frame([(n,) for n in needles], "a string"), frame([(t,) for t in texts], "b string"))
    assert {tuple(r) for r in found.collect()} == {(n, t) for n in needles if n for t in texts if t and n in t}


def parts(path, suffix=".csv"):
    return b"".join(p.read_bytes() for p in sorted(path.glob(f"*{suffix}")))


def test_load_file_dialect(frame, tmp_path):
    df = frame([('say "hi"', "a,b", " pad ", ""), ("ödling", "x", None, "y")], "`A(k/*)` string, B string, C string, D string")
    sinks.write_load_file(df.coalesce(1), str(tmp_path / "S_X#1"))
    assert parts(tmp_path / "S_X#1") == 'A(k/*),B,C,D\r\n"say ""hi""","a,b", pad ,\r\nödling,x,,y\r\n'.encode()


def test_rejects_only_when_there_are_any(frame, tmp_path):
    df = frame([(1, "A.required")], "__rownum int, __errors string")
    assert not sinks.write_rejects(df.filter("false"), str(tmp_path / "none")) and not (tmp_path / "none").exists()
    assert sinks.write_rejects(df, str(tmp_path / "some")) and b"A.required" in parts(tmp_path / "some")


def test_addressed_output_and_exports(spark, frame, tmp_path):
    df = frame([("a", 1)], "v string, n int")
    for run in ("t1", "t2"):
        sinks.write_addressed(df, str(tmp_path / "out"), "o", "v", run)
    assert (tmp_path / "out" / "object=o" / "variant=v" / "run_ts=t1").exists()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    sinks.write_stats(df, str(tmp_path / "stats"))
    assert spark.read.json(str(tmp_path / "stats" / "json")).count() == 1
    assert sinks.list_export(df, "n").collect()[0].Item == "1"


def test_catalogue_generations(frame):
    old = frame([("banks", "Country", True)], "sap_field string, field_description string, mandatory boolean")
    new = frame([("BANKS", "Country", True)], "target_field string, target_field_description string, target_is_mandatory boolean")
    for df in (old, new):
        row = catalog.harmonize(df, catalog.TARGET_NAMES).first()
        assert row.field_name.lower() == "banks" and row.is_mandatory is True and row.is_key is None


def test_contracts(frame):
    mapping = frame([("o", "v", "A", 1.5), ("o", "v", "B", 1.0), ("o", "v", "C", -0.1), ("o", "v", "D", None)], "object string, variant string, target_field string, confidence double")
    assert {r.target_field for r in catalog.mapping_violations(mapping).collect()} == {"A", "C"}
    sources = frame([("o", "v", None), ("o", "v", "A")], "object string, variant string, field_name string")
    assert catalog.source_violations(sources).count() == 1
    wanted = frame([("o", "v"), ("o", "w")], "object string, variant string")
    assert [r.variant for r in catalog.empty_catalogues(wanted, sources, ["object", "variant"]).collect()] == ["w"]
    skip = frame([("A", None, True, "c")], "source_field string, source_description string, skip boolean, comment string")
    manual = frame([("A", "d", "T", "td", None)], "source_field string, source_description string, target string, target_description string, comment string")
    assert {r.violation for r in catalog.memory_violations(skip, manual).collect()} == {"source_description missing", "comment missing"}


def test_decisions(frame):
    by = "object string, variant string"
    s = frame([("o", "v", f) for f in "ABCD"], f"{by}, field_name string")
    matched = frame([("o", "v", "A", "T1", 0.9)], f"{by}, source_field string, target_field string, confidence double")
    manual = frame([("o", "v", "A", "T9", 1.0), ("o", "v", "B", "T1", 1.0)], f"{by}, field_name string, target_field string, confidence double")
    skipped = frame([("o", "v", "C", 1.0, "why")], f"{by}, field_name string, confidence double, reason string")
    got = {r.source_field: (r.status, r.target_field) for r in decision.decision_table(s, matched, manual, skipped).collect()}
    assert got == {"A": ("mapped", "T1"), "B": ("manual", "T1"), "C": ("skipped", ""), "D": ("pending", "")}
    assert [tuple(r)[2:] for r in decision.conflicts(manual, matched).collect()] == [("T1", "B", "A")]
    targets = frame([("o", "v", "T1", "x"), ("o", "v", "DELFLAG", ""), ("o", "v", "PRICE", "net")], f"{by}, field_name string, description string")
    rest = {r.field_name: (r.rule, r.confidence) for r in decision.residual_targets(targets, matched).collect()}
    assert rest == {"DELFLAG": ("constant", 0.9), "PRICE": ("derive", 0.8)}


def test_memory_document(spark, frame, tmp_path):
    told = lambda f, **more: {"source_field": f, "source_description": f.lower(), "comment": "c", **more}
    doc = {
        "synonyms": {"BANKL": ["Bank Key", "Bank ID"], "BANKA": ["Bank Name"]},
        "global_skip_fields": [told("MANDT", skip=True)],
        "global_manual_mappings": [told("ERNAM", target="CREATOR", target_description="d")],
        "table_specific": {"m_140_bnka": {"skip_fields": [told("ERDAT", skip=True)]}, "other_x": {"manual_mappings": [told("A", target="B", target_description="d")]}},
    }
    path = write(tmp_path, "memory.json", json.dumps(doc, indent=1))
    objects = frame([("m_140", "bnka"), ("m1", "y")], "object string, variant string")
    skip, manual, synonyms = metadata.read_memory(spark, path, objects)
    assert {(r.level, r.object, r.source_field) for r in skip.collect()} == {(0, None, "MANDT"), (1, "m_140", "ERDAT")}
    assert [r.target for r in manual.collect()] == ["CREATOR"]
    assert {(r.target, r.variant) for r in synonyms.collect()} == {("BANKL", "Bank Key"), ("BANKL", "Bank ID"), ("BANKA", "Bank Name")}
    fields = "object string, variant string, field_name string, description string, example string, ordinal int"
    sources = frame([("m_140", "bnka", "Column1", None, "my bank id", 1), ("m_140", "bnka", "ERDAT", None, "1", 2)], fields)
    named = {r.ordinal: r.field_name for r in memory.name_unclear_headers(sources, manual, synonyms).collect()}
    assert named == {1: "BANKL", 2: "ERDAT"}
    assert memory.skip_fields(sources, skip)[1].count() == 1


def test_catalogue_documents_of_two_generations(spark, tmp_path):
    meta = {"object": "o", "variant": "v"}
    write(tmp_path, "a.json", json.dumps({"metadata": meta, "source_fields": [{"field_name": "A", "nullable": True, "field_count": 1}]}))
    write(tmp_path, "b.json", json.dumps({"metadata": meta, "source_fields": [{"source_field_name": "B", "source_nullable": False, "source_field_count": 2}]}))
    rows = metadata.read_catalogue(spark, str(tmp_path), "source_fields", catalog.SOURCE_NAMES).collect()
    assert {(r.field_name, r.ordinal, r.nullable) for r in rows} == {("A", 1, True), ("B", 2, False)}


def test_repair_keeps_character_references(frame):
    raw = '<Cell ss:Name="caf&#xE9;" ss:Index="4"><Cell a="1" &bad stuff>'
    assert frame([(raw,)], "v string").select(markup.repair_markup(F.col("v"))).first()[0] == '<Cell ss:Name="caf&#xE9;" ss:Index="4"><Cell a="1" >'


def test_wide_sheet_keeps_all_cells(frame):
    cells = frame([("f", "s", 1, c, f"v{c}", 0) for c in range(1, 41)], "file string, sheet string, row_no int, col_no int, value string, merge_down int")
    assert [r.cells for r in markup.carry_merged(cells).collect()] == [[f"v{c}" for c in range(1, 41)]]
