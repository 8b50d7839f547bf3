"""Workbooks, encodings kept up to date, geocoding that goes on where it broke off."""

import http.server
import json
import threading
import urllib.parse
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from concordia import models
from concordia.functions import divisions
from concordia.sources import io, workbook

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def write_book(path, sheets, shared=(), early=False, dimension=True):
    """sheets: {name: XML of its rows, or (dimension, XML)}."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS}><workbookPr date1904="{int(early)}"/><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        links = "".join(f'<Relationship Id="rId{i}" Type="x" Target="{"worksheets" if i % 2 else "/xl/worksheets"}/sheet{i}.xml"/>' for i, _ in enumerate(sheets, 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si>{s}</si>" for s in shared) + "</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {NS}><numFmts><numFmt numFmtId="164" formatCode="yyyy&quot;年&quot;m"/><numFmt numFmtId="165" formatCode="0.00&quot;d&quot;[Red]"/></numFmts><cellXfs>' + "".join(f'<xf numFmtId="{f}"/>' for f in (0, 14, 22, 164, 165, 21)) + "</cellXfs></styleSheet>")
        for i, rows in enumerate(sheets.values(), 1):
            size, rows = rows if isinstance(rows, tuple) else ("A1:H9", rows)
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {NS}>" + (f'<dimension ref="{size}"/>' if dimension else "") + f"<sheetData>{rows}</sheetData></worksheet>")


def test_workbook_cells(spark, tmp_path):
    shared = ["<t>名称</t>", "<t>a&amp;b</t>", "<r><t>rich </t></r><r><t>text</t></r><rPh><t>no</t></rPh>"]
    rows = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>when</t></is></c><c r="D1" t="s"><v>0</v></c></row>'
        '<row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2" s="1"><v>45000</v></c><c r="C2"><v>1.50</v></c><c r="D2" t="b"><v>1</v></c></row>'
        '<row r="4"><c t="s"><v>2</v></c><c s="2"><v>45000.75</v></c><c><v>12345678901234567</v></c><c t="e"><v>#N/A</v></c></row>'
        '<row><c r="A5" t="str"><f>1+1</f><v>two</v></c><c r="B5" s="3"><v>59</v></c><c r="C5" s="4"><v>7.0</v></c><c r="D5" s="5"><v>0.5</v></c></row>'
    )
    write_book(tmp_path / "a.XLSX", {"first": rows, "二": '<row r="1"><c r="A1"><v>1</v></c></row><row r="2"><c r="A2"><v>3</v></c></row>'}, shared)
    df = io.read_table(spark, str(tmp_path / "a.XLSX"))
    assert df.columns == ["名称", "when", "Unnamed: 2", "名称.1"]
    assert [tuple(r) for r in df.collect()] == [("a&b", "2023-03-15", "1.5", "True"), (None, None, None, None), ("rich text", "2023-03-15 18:00:00", "12345678901234567", None), ("two", "1900-02-28", "7", "12:00:00")]
    two = io.read_excel(spark, str(tmp_path / "a.XLSX"), "二")
    assert two.columns == ["1"] and [r[0] for r in two.collect()] == ["3"] and io.read_excel(spark, str(tmp_path / "a.XLSX"), 1).columns == ["1"]
    pruned = workbook.read_workbook(spark, str(tmp_path / "a.XLSX"), columns=["名称.1", "when"])
    assert [tuple(r) for r in pruned.collect()][0] == ("True", "2023-03-15")
    write_book(tmp_path / "early.xlsx", {"x": rows}, shared, early=True, dimension=False)
    assert io.read_table(spark, str(tmp_path / "early.xlsx")).first()["when"] == "2027-03-16"
    for bad in (lambda: io.read_excel(spark, str(tmp_path / "a.XLSX"), "none").collect(), lambda: workbook.read_workbook(spark, str(tmp_path / "a.XLSX"), columns=["none"]).collect()):
        with pytest.raises(Exception, match="none"):
            bad()
    with pytest.raises(ValueError, match="xls"):
        io.read_table(spark, str(tmp_path / "a.xls"))


@pytest.mark.parametrize("said", ["A1:B2501", "A1:B900", "A1", "A1:B4000"])
def test_workbook_is_read_by_ranges_of_rows(spark, tmp_path, said):
    rows = '<row r="1"><c r="A1" t="inlineStr"><is><t>id</t></is></c><c r="B1" t="inlineStr"><is><t>name</t></is></c></row>' + "".join(f'<row r="{i}"><c r="A{i}"><v>{i}</v></c><c r="B{i}" t="s"><v>{i % 7}</v></c></row>' for i in range(2, 2502))
    write_book(tmp_path / "b.xlsx", {"s": (said, rows)}, [f"<t>n{i}</t>" for i in range(7)])
    df = workbook.read_workbook(spark, str(tmp_path / "b.xlsx"), rows_per_task=500)
    last = int(said.rsplit("B", 1)[-1].lstrip("A"))
    assert df.rdd.getNumPartitions() == max(1, -(-(last - 1) // 500))
    assert [tuple(r) for r in df.collect()] == [(str(i), f"n{i % 7}") for i in range(2, 2502)]


def test_workbook_without_rows(spark, tmp_path):
    write_book(tmp_path / "c.xlsx", {"s": '<row r="1"><c r="A1" t="inlineStr"><is><t>id</t></is></c></row>'})
    df = io.read_table(spark, str(tmp_path / "c.xlsx"))
    assert df.columns == ["id"] and df.count() == 0


def test_encodings_are_kept_up_to_date(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def load():
        def model(texts):
            import uuid

            (calls / uuid.uuid4().hex).write_text(json.dumps(texts))
            return [[float(len(t))] for t in texts]

        return model

    def asked():
        out = sorted(t for f in calls.iterdir() for t in json.loads(f.read_text()))
        for f in calls.iterdir():
            f.unlink()
        return out

    encode = lambda df: models.encode(df, "text", load)
    update = lambda rows: {r["id"]: r["vector"][0] for r in io.encoded(spark, str(tmp_path / "kept"), spark.createDataFrame(rows, "id string, text string, vector int").drop("vector"), encode, "m1", fan_out=3).collect()}
    first = [("a", "xx", 1), ("b", "yyy", 1), ("c", None, 1), (None, "zz", 1)]
    assert update(first) == {"a": 2.0, "b": 3.0, "c": 0.0} and asked() == ["", "xx", "yyy"]
    assert update(first) == {"a": 2.0, "b": 3.0, "c": 0.0} and asked() == []
    assert update([("a", "xx", 1), ("b", "yyyy", 1), ("d", "w", 1)]) == {"a": 2.0, "b": 4.0, "d": 1.0} and asked() == ["w", "yyyy"]
    assert update([("a", "xx", 1)]) == {"a": 2.0} and asked() == []  # the third segment: all become one
    kept = str(tmp_path / "kept" / "m1")
    assert len(io._segments(spark, kept)) == 1 and spark.read.parquet(*io._segments(spark, kept)).count() == 1
    assert update([("a", "xx", 1), ("b", "yyy", 1)]) == {"a": 2.0, "b": 3.0} and asked() == ["yyy"]  # what was gone is new again
    (tmp_path / "kept" / "m1" / "segment=00000099").mkdir()  # a run that broke off
    assert update([("a", "xx", 1), ("b", "yyy", 1)]) == {"a": 2.0, "b": 3.0} and asked() == []
    assert update([]) == {}


class Service:
    """A geocoder's service that counts its calls, and fails as it is told."""

    def __init__(self):
        self.calls, self.fail = Counter(), {}
        service = self

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_GET(self):
                asked = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items()}
                at = asked["address"]
                service.calls[at, asked.get("city", "")] += 1
                status, body = service.fail.get(at, lambda n: (200, None))(sum(service.calls.values()))
                if body is None:
                    body = {"status": "1", "geocodes": [] if at == "nowhere" else [{"province": "P", "city": [] if at == "odd" else f"C-{at}{asked.get('city', '')}", "district": "D", "adcode": "1"}]}
                self.send_response(status)
                self.end_headers()
                self.wfile.write(json.dumps(body).encode())

            def log_message(self, *args):
                pass

        self.server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_port}/geo"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()


@pytest.fixture
def service():
    s = Service()
    yield s
    s.server.shutdown()


def test_geocoding_goes_on_where_it_broke_off(spark, tmp_path, service):
    df = spark.createDataFrame([(i, f"road {i % 30}", None if i % 2 else "X", "mine") for i in range(100)] + [(200, None, "X", ""), (201, "nowhere", "X", ""), (202, "odd", None, ""), (203, "  ", None, "")], "id int, addr string, hint string, found_it string")
    path, options = str(tmp_path / "answers"), {"city": "hint", "rate": 1e6, "callers": 2, "wait": 0.001}
    left = [15]

    def day(n):  # a day's calls are used up after fifteen
        left[0] -= 1
        return (200, {"status": "0", "info": "QUOTA"}) if left[0] < 0 else (200, None)

    service.fail = {f"road {i}": day for i in range(30)}
    run = lambda: {r["id"]: r for r in models.geocode_table(df, "addr", models.http_geocoder("k", service.url), path, batch=10, **options).collect()}
    out = run()
    errors = Counter(r["found_error"] for r in out.values())
    assert errors["blank"] == 2 and errors[None] < 100 and any(k and k.startswith(("refused", "stopped")) for k in errors)
    answered = {k for k, n in service.calls.items()}
    service.fail, before = {}, Counter(service.calls)
    out = run()
    assert Counter(r["found_error"] for r in out.values()) == {None: 101, "blank": 2, "not found": 1}
    assert out[3]["found_city"] == "C-road 3" and out[4]["found_city"] == "C-road 4X" and out[202]["found_city"] == "[]" and out[3]["found_it"] == "mine"
    # each distinct address and hint was answered once: what was asked twice had been refused
    assert set(service.calls) == {(f"road {i % 30}", "" if i % 2 else "X") for i in range(100)} | {("nowhere", "X"), ("odd", "")} and answered <= set(service.calls)
    assert sum(service.calls.values()) - sum(before.values()) <= len(service.calls) - 13
    before = Counter(service.calls)
    assert run()[3]["found_city"] == "C-road 3" and service.calls == before  # nothing is asked again, not found included


def test_geocoding_repeats_what_may_go_away(spark, service):
    service.fail = {"once": lambda n: (500, {}) if n == 1 else (200, None), "never": lambda n: (400, {}), "broken": lambda n: (503, {})}
    ask = lambda a: models.geocode(spark.createDataFrame([(a,)], "addr string"), "addr", models.http_geocoder("k", service.url), 0, wait=0.001).first()
    assert ask("once")["found_city"] == "C-once" and service.calls["once", ""] == 2
    assert ask("never")["found_error"] == "http 400" and service.calls["never", ""] == 1
    assert ask("broken")["found_error"] == "http 503" and service.calls["broken", ""] == 3
    assert ask("")["found_error"] == "blank" and ("", "") not in service.calls
    lost = models.geocode(spark.createDataFrame([("x",)], "addr string"), "addr", models.http_geocoder("k", "http://127.0.0.1:9/"), 0, wait=0.001).first()
    assert lost["found_error"] == "connection"


def test_segments_by_hand(spark):
    table = divisions.divisions(spark).unionByName(spark.createDataFrame([("110100", "市辖区"), ("bad", "朝阳市"), (None, "x"), ("110101", None)], divisions.SCHEMA))
    cases = {
        "江苏省徐州市鼓楼区中山北路1号": ("江苏省", "徐州市", "鼓楼区"), "福州鼓楼区五四路": ("福建省", "福州市", "鼓楼区"), "河南开封市鼓楼区": ("河南省", "开封市", "鼓楼区"),
        "鼓楼区某街": ("江苏省", "南京市", "鼓楼区"), "北京朝阳区建国路": ("北京市", "北京市", "朝阳区"), "上海浦东新区世纪大道": ("上海市", "上海市", "浦东新区"), "杭州西湖区文三路": ("浙江省", "杭州市", "西湖区"),
        "南昌市西湖区": ("江西省", "南昌市", "西湖区"), "和平区在沈阳": ("天津市", "天津市", "和平区"), "沈阳和平区": ("辽宁省", "沈阳市", "和平区"), "湖北仙桃市": ("湖北省", "", "仙桃市"), "成都崇州市": ("四川省", "成都市", "崇州市"),
        "广西南宁": ("广西壮族自治区", "南宁市", ""), "no place": ("", "", ""), "": ("", "", ""), None: ("", "", ""), "长春路": ("吉林省", "长春市", ""),
    }
    df = spark.createDataFrame([(k, "x") for k in cases] + [("福州鼓楼区五四路", "again")], "addr string, code string")
    out = divisions.segment(df, "addr", table)
    assert out.columns == ["addr", "code", "seg_province", "seg_city", "seg_district"] and out.count() == len(cases) + 1
    assert {r["addr"]: (r["seg_province"], r["seg_city"], r["seg_district"]) for r in out.collect()} == cases
    assert divisions.segment(df.limit(0), "addr", table).count() == 0 and divisions.segment(df, "addr", table.limit(0)).where("seg_city <> ''").count() == 0


def test_counties_agree_with_a_plain_walk(spark):
    parts = divisions.DIVISIONS.split()
    own = dict(zip(parts[::2], parts[1::2], strict=True))
    want: dict = {}
    for code, name in own.items():
        above = [own[c] for c in (code[:4] + "00", code[:2] + "0000") if c in own and (not c.endswith("0000") or own[c].endswith("市"))]
        if code.endswith("00") and own[code] in above[:1] or not code.endswith("00") and name.endswith("市") and above:
            want.setdefault(name, set()).add(above[0])
    want = {k: v.pop() for k, v in want.items() if len(v) == 1}
    found = {r["name"]: r["target"] for r in divisions.county_table(divisions.divisions(spark)).collect()}
    assert found == want and found["崇州市"] == "成都市" and found["阆中市"] == "南充市" and "仙桃市" not in found and found["北京市"] == "北京市"
    from concordia.functions import city

    df = spark.createDataFrame([("崇州市",), ("桐乡市",), ("广东广州市",)], "c string")
    assert [r["city_norm"] for r in city.normalize_city(df, "c").orderBy("c").collect()] == ["成都市", "广州市", "嘉兴市"]


def test_texts_go_to_the_model_by_length_within_a_budget(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    texts = ["w" * int(n) for n in rng.gamma(2.0, 40.0, 2000)] + [None, ""]
    seen = []
    answers = models.in_batches([t or "" for t in texts], lambda batch: seen.append([len(b) for b in batch]) or [b[:3] for b in batch], 4096, join="".join)
    assert answers == [(t or "")[:3] for t in texts]
    padded, real = sum(max(1, *b) * len(b) if len(b) > 1 else b[0] for b in seen), sum(map(sum, seen))
    assert padded <= 1.15 * real and max(max(b) for b in seen) == 256 and all(max(b) * len(b) <= 4096 for b in seen)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    plain = {r["id"]: r["vector"] for r in models.encode(df.where("length(t) <= 256 or t is null"), "t", models.hashing_encoder(8)).collect()}
    own = {r["id"]: r["vector"] for r in models.encode(df, "t", models.hashing_encoder(8), budget=2048).collect()}
    assert len(own) == len(texts) and all(own[i] == v for i, v in plain.items())
    assert [list(b) for b in models.budget_batches([300, 1, 2], 100)] == [[0], [2, 1]]


def test_adapter_steps_like_its_twin(spark):
    import numpy as np

    from concordia.operators import adapter

    rng = np.random.default_rng(2)
    turn = np.linalg.qr(rng.normal(size=(12, 12)))[0]
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    q = unit(rng.normal(size=(150, 12)))
    p, n = unit(0.4 * q + q @ turn), unit(rng.normal(size=(150, 12)))
    rows = [(f"q{i}", q[i].tolist(), p[i].tolist(), None if i % 5 == 0 else n[i].tolist()) for i in range(150)]
    pairs = spark.createDataFrame([*rows, ("none", None, p[0].tolist(), None)], "q_id string, qv array<double>, pv array<double>, nv array<double>")
    options = {"batch": 32, "steps": 12, "rank": 4, "rate": 0.3}
    found, losses = adapter.tune(pairs.repartition(3), **options)
    assert losses[-1] < 0.9 * losses[0]
    # a twin: the same batches, the loss's gradient by differences of autograd-free formulas
    batch = {r["q_id"]: r["b"] for r in pairs.where("qv is not null").select("q_id", F.pmod(F.xxhash64(F.lit(42), "q_id"), F.lit(150 // 32)).cast("int").alias("b")).collect()}
    a, b = adapter.begin(12, 4).a, adapter.begin(12, 4).b

    def loss(a, b):
        total = 0.0
        for g in set(batch.values()):
            own = [i for i in range(150) if batch[f"q{i}"] == g]
            e = lambda x: unit(x + x @ a @ b)
            others = np.concatenate([e(p[own]), e(n[[i for i in own if i % 5]])])
            s = 20 * e(q[own]) @ others.T
            total += float((np.log(np.exp(s).sum(1)) - s[np.arange(len(own)), np.arange(len(own))]).sum())
        return total

    def slope(f, x, h=1e-6):
        out = np.zeros_like(x)
        for i in np.ndindex(*x.shape):
            d = np.zeros_like(x)
            d[i] = h
            out[i] = (f(x + d) - f(x - d)) / (2 * h)
        return out

    for step in range(12):
        assert abs(losses[step] - loss(a, b) / 150) < 1e-6
        move = adapter.rate_at(step, 12, 0.3, 0.1) / 150
        ga, gb = slope(lambda x: loss(x, b), a), slope(lambda x: loss(a, x), b)  # noqa: B023
        a, b = a - move * ga, b - move * gb
    assert np.allclose(found.a, a, atol=1e-5) and np.allclose(found.b, b, atol=1e-5)
    out = models.encode(spark.createDataFrame([("some text",)], "t string"), "t", adapter.adapted(models.hashing_encoder(12), found)).first()["vector"]
    assert np.allclose(out, found(models.hashing_encoder(12)()(["some text"]))[0], atol=1e-6)
    assert adapter.tune(pairs.limit(0)) is not None


def test_parts_of_addresses_are_not_shuffled(spark):
    df = spark.createDataFrame([("浙江省杭州市西湖区文三路",), ("",), (None,)], "addr string")
    p = divisions.segment(df, "addr", divisions.divisions(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert p.count("strategy=broadcast") == 3
