"""Parts of workbooks, folders imported again and again, and codecs, on files made here."""

import hashlib
import io
import os
import unicodedata
import zipfile

import pytest
from pyspark.sql import functions as F

from quadrille.operators import charset
from quadrille.operators import validations as V
from quadrille.sources import imports, parts, xlsx

REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
XDR = "http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing"
ART = "http://schemas.openxmlformats.org/drawingml/2006/main"
PICTURES = {"image1.png": b"\x89PNG one", "image2.png": b"\x89PNG two" * 200_000}


def _relations(**targets):
    return f'<Relationships xmlns="{parts.PACKAGE[1:-1]}">' + "".join(f'<Relationship Id="{k}" Type="x" Target="{v}"/>' for k, v in targets.items()) + "</Relationships>"


def _anchor(kind, inner, at=None, to=None):
    place = lambda name, x: f"<d:{name}><d:col>{x[1]}</d:col><d:colOff>0</d:colOff><d:row>{x[0]}</d:row><d:rowOff>0</d:rowOff></d:{name}>" if x else ""
    return f"<d:{kind}>{place('from', at)}{place('to', to)}{inner}</d:{kind}>"


def _picture(key):
    return f'<d:pic><d:blipFill><a:blip r:embed="{key}"/></d:blipFill></d:pic>'


def _box(*lines):
    return "<d:sp><d:txBody>" + "".join(f"<a:p><a:r><a:t>{x}</a:t></a:r></a:p>" for x in lines) + "</d:txBody></d:sp>"


def drawn_book(broken: str | None = None) -> bytes:
    """Two sheets with a drawing each; the first also has two drop-down lists."""
    drawing = lambda *anchors: f'<d:wsDr xmlns:d="{XDR}" xmlns:a="{ART}" xmlns:r="{REL}">{"".join(anchors)}</d:wsDr>'
    out = io.BytesIO()
    lists = '<dataValidations count="2"><dataValidation type="list" sqref="B2:B4 D2"><formula1>"y,n"</formula1></dataValidation><dataValidation type="list" sqref="C2"><formula1>=$A$2:$A$3</formula1></dataValidation></dataValidations><drawing r:id="r1"/>'
    with zipfile.ZipFile(io.BytesIO(xlsx.workbook({"First": [["a", "b"], ["x", "y"], ["z", "n"]], "Second": [["c"]]}))) as old, zipfile.ZipFile(out, "w") as z:
        for name in old.namelist():
            text = old.read(name)
            if name.startswith("xl/worksheets/"):
                more = lists if name.endswith("1.xml") else '<drawing r:id="r1"/>'
                text = text.replace(b"</worksheet>", more.encode() + b"</worksheet>").replace(b"<worksheet ", f'<worksheet xmlns:r="{REL}" '.encode())
            z.writestr(name, text)
        for i in (1, 2):
            z.writestr(f"xl/worksheets/_rels/sheet{i}.xml.rels", _relations(r1=f"../drawings/drawing{i}.xml"))
            z.writestr(f"xl/drawings/_rels/drawing{i}.xml.rels", _relations(p1="../media/image1.png", p2="/xl/media/image2.png"))
        z.writestr("xl/drawings/drawing1.xml", drawing(
            _anchor("twoCellAnchor", _picture("p2"), (4, 1), (9, 3)), _anchor("oneCellAnchor", _box(" Note ", "", "second line"), (0, 27)), _anchor("absoluteAnchor", _picture("p1")),
            _anchor("twoCellAnchor", _box("wide"), (1, 0), (2, 5)), _anchor("oneCellAnchor", _picture("none"), (0, 0))))
        z.writestr("xl/drawings/drawing2.xml", "<broken" if broken == "drawing" else drawing(_anchor("oneCellAnchor", _picture("p2"), (0, 0))))
        for name, raw in PICTURES.items():
            z.writestr(f"xl/media/{name}", raw)
    return out.getvalue()


@pytest.fixture
def books(tmp_path):
    (tmp_path / "a.xlsx").write_bytes(drawn_book())
    (tmp_path / "b.xlsm").write_bytes(drawn_book("drawing"))
    (tmp_path / "c.xlsx").write_bytes(b"no archive")
    return str(tmp_path)


def test_parts_of_workbooks(spark, books):
    found = parts.elements(spark, books)
    of = lambda df, file="a.xlsx": [r.asDict() for r in df.where(F.col("path").endswith(file)).drop("path").collect()]
    pictures = sorted(of(parts.images(found)), key=lambda r: r["id"])
    assert [(r["sheet"], r["local_index"], r["placeholder"], r["type"], r["anchor_cell"]) for r in pictures] == [
        ("First", 0, "[IMAGE_PLACEHOLDER_0]", "cell_image", "B5"), ("First", 1, "[IMAGE_PLACEHOLDER_1]", "sheet_image", None),
        ("First", 2, "[IMAGE_PLACEHOLDER_2]", "cell_image", "A1"), ("Second", 0, "[IMAGE_PLACEHOLDER_3]", "cell_image", "A1")]
    digest = {k: hashlib.sha256(v).hexdigest()[:16] for k, v in PICTURES.items()}
    assert [(r["size_bytes"], r["image_hash"]) for r in pictures] == [(len(PICTURES[n]), digest[n]) if n else (None, None) for n in ("image2.png", "image1.png", None, "image2.png")]
    boxes = sorted(of(parts.text_boxes(found)), key=lambda r: r["textbox_id"])
    assert [(r["a1_range"], r["text"], r["line_count"]) for r in boxes] == [("AB1:AB1", "Note\nsecond line", 2), ("A2:F3", "wide", 1)]
    assert {(r["member"], r["error"].split(":")[0]) for r in of(parts.errors(found), "b.xlsm")} == {("xl/drawings/drawing2.xml", "ParseError")}
    assert len(of(parts.images(found), "b.xlsm")) == 3 and of(parts.errors(found), "a.xlsx") == []
    assert [r["member"] for r in of(parts.errors(found), "c.xlsx")] == [None]


def test_lists_of_files_reach_the_cells(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(drawn_book())
    lists = parts.validations(parts.elements(spark, str(tmp_path))).drop("path")
    cells = xlsx.read(spark, str(tmp_path)).drop("path")
    got = {(r["row"], r["col"]): list(r["options"]) for r in V.by_cell(V.resolved(lists, cells)).collect()}
    assert got == {(2, 2): ["y", "n"], (3, 2): ["y", "n"], (4, 2): ["y", "n"], (2, 4): ["y", "n"], (2, 3): ["x", "z"]}


def _names(df):
    return sorted(os.path.basename(r["path"]) for r in df.select("path").distinct().collect())


def test_rerun_reads_changed_files_only(spark, tmp_path):
    data, folder = tmp_path / "in", str(tmp_path / "manifests")
    (data / "sub").mkdir(parents=True)
    (data / "a.xlsx").write_bytes(xlsx.workbook({"s": [["x", 1]]}))
    (data / "b[1] {c}.csv").write_bytes("名稱;數量\nq;\"2;5\"\n".encode("cp950"))
    (data / "sub" / "d.md").write_bytes("# été".encode())
    (data / "e.json").write_text('{"k": "\\u91cd"}')
    (data / "f.json").write_text("{")
    (data / "g.xlsx").write_bytes(b"broken")
    (data / "h.bin").write_bytes(b"1")
    (data / "empty.txt").write_bytes(b"")
    first = imports.run(spark, str(data), folder)
    assert first.version == 1 and first.changed.count() == 7 and first.removed.count() == 0
    assert {(os.path.basename(r["path"]), r["sheet"], r["row"], r["col"], r["raw"]) for r in first.cells.collect()} == {
        ("a.xlsx", "s", 1, 1, "x"), ("a.xlsx", "s", 1, 2, "1"), ("b[1] {c}.csv", "Sheet1", 1, 1, "名稱"), ("b[1] {c}.csv", "Sheet1", 1, 2, "數量"),
        ("b[1] {c}.csv", "Sheet1", 2, 1, "q"), ("b[1] {c}.csv", "Sheet1", 2, 2, "2;5")}
    assert {(r["parser_type"], r["text"]) for r in first.texts.collect()} == {("md", "# été"), ("json", '{"k": "重"}')}
    assert _names(first.errors) == ["f.json", "g.xlsx", "h.bin"]

    again = imports.run(spark, str(data), folder)
    assert again.version == 1 and again.rows.count() == 0 and again.changed.count() == 0

    (data / "f.json").write_text("[1]")
    os.utime(data / "e.json", (1_000_000_000, 1_000_000_000))
    (data / "h.bin").unlink()
    third = imports.run(spark, str(data), folder)
    assert third.version == 2 and _names(third.rows) == ["e.json", "f.json"] and _names(third.removed) == ["h.bin"]
    assert imports.manifest(spark, folder).count() == 6 and imports.manifest(spark, folder, 1).count() == 7

    with pytest.raises(imports.ManifestConflict):
        imports._commit(imports.manifest(spark, folder), folder, 2)
    assert sorted(x for x in os.listdir(folder) if not x.endswith(".crc")) == ["00000001", "00000002"]


TEXTS = {
    "big5": ("機器學習的模型需要大量資料，我們每天都在處理這些表格。", "請檢查總數是否等於各部分之和。", "訂單的金額與數量不一致，請通知供應商。", "本月庫存比上月減少 15%，下週會補貨。"),
    "gb2312": ("机器学习的模型需要大量数据，我们每天都在处理这些表格。", "请检查总数是否等于各部分之和。", "订单的金额与数量不一致，请通知供应商。", "本月库存比上月减少 15%，下周会补货。"),
    "utf-8": ("Überall gelten die gleichen Regeln.", "機器學習的模型", "Tệp này có năm cột.", "naïve café"),
    "iso-8859-1": ("Les données sont vérifiées à l'arrivée.", "Änderungen müssen überprüft werden.", "El niño comió mañana según el señor.", "À la une: Énorme succès en été"),
    "windows-1252": ("Les données “brutes” sont vérifiées à l’arrivée.", "Größe – 5 € je Stück", "C’est l’été…", "œuvre et cœur sont liés"),
    "windows-1258": ("Chúng tôi kiểm tra số lượng và giá của mỗi đơn hàng.", "Tổng số phải bằng tổng của các phần.", "Kho hàng tháng này giảm so với tháng trước.", "Xin thông báo cho nhà cung cấp."),
}


def _vietnamese(text):
    """Base letters, then tone marks, as windows-1258 has them."""
    out = b""
    for ch in unicodedata.normalize("NFC", text):
        apart = unicodedata.normalize("NFD", ch)
        tones = "".join(x for x in apart if x in "̣̀́̃̉")
        try:
            out += ch.encode("cp1258")
        except UnicodeEncodeError:
            out += (unicodedata.normalize("NFC", "".join(x for x in apart if x not in tones)) + tones).encode("cp1258")
    return out


def test_codecs_are_told_apart(spark):
    raw = [(want, _vietnamese(t) if want == "windows-1258" else t.encode(want)) for want, texts in TEXTS.items() for t in texts]
    raw += [("ascii", b""), ("ascii", b"plain"), (None, None), ("utf-8-sig", "é".encode("utf-8-sig")), ("utf-16", "é".encode("utf-16")), ("utf-8", b"\x81\x81\xff\xff\x8d" * 3)]
    got = charset.guessed(spark.createDataFrame(raw, "want string, content binary")).collect()
    assert [(r["want"], r["codec"]) for r in got] == [(w, w) for w, _ in raw]
    long = ("訂單的金額與數量不一致。" * 40_000).encode("big5")
    assert charset.guess(long)[0] == "big5"
