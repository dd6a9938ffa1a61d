"""Rules: Java against Python regexes, gates as necessary conditions, labelled fixtures."""

import re

import pytest
from pyspark.sql import functions as F

from cloakframe.operators import detect
from cloakframe.operators.arbitrate import arbitrate
from cloakframe.operators.rules import built_in_rules, extraction_name_rules
from cloakframe.plans.rule_queries import CASES, _sql
from cloakframe.sources.texts import scan_texts

DIGITS = "0123456789"
HEX = "0123456789abcdef" * 8


def texts():
    """Own texts in many scripts; secrets are assembled here, none is real."""
    return [
        "联系人：张伟，手机号：138" + "00138000，邮箱 zhang.wei@example.com 😀 好",
        "My name is John Smith. I live at 12 Main Street, Town. Call +1 415-555-0101!",
        "Je m'appelle Marie Curie et J'habite au 5 rue de la Paix. Ma date de naissance est le 5 mai 1990",
        "Mein Name ist Jörg Müller. Ich wohne in der Hauptstraße 5. Mein Geburtsdatum ist der 3 Mai 1980",
        "Me llamo Ana García. Vivo en Calle Mayor 7. Nací el 4 abril 1991",
        "Меня зовут Иван Петров. Я живу по адресу: улица Ленина 5. Дата рождения: 4 мая 1990 года",
        "私の名前は山田太郎。住所は東京都新宿区西新宿1-2です。生年月日は1990年5月3日",
        "제 이름은 홍길동 입니다. 주소는 서울시 강남구 1번지입니다. 비밀번호는 abc12345x",
        "اسمي محمد علي. أسكن في شارع الملك 5. كلمة المرور هي abc12345",
        "ฉันชื่อ สมชาย ใจดี ที่อยู่คือ 5 ถนน หมายเลขโทรศัพท์ 0812345678",
        "token = \"" + HEX[:24] + "\"; PASSWORD: 'x'; DB_PASSWORD=Abc123!!, password is " + HEX[:12],
        "postgres://u:p@h.example.com/x jdbc:mysql://h/d?x=1 \n AKIA" + "ABCDEFGH23456789" + " end",
        "IP地址：10.0.0.1 IPv6: fe80::1 MAC address: 00:1a:2b:3c:4d:5e 192.168.1.9.",
        "身份证号：11010519491231002X 车牌 京A12345，微信号：wx_abcdef 生日：1990年5月",
        "用户名是小明 username: bob_7 MRN: A12345 学号：STU-1 有效期：12/27 CVV 123",
        " password: \" abc def1 \" \r\n passport number: X1234567   BIC: DEUTDEFF500",
        "我是王小明，由李四经理负责，请联系陈静。姓名：管理员 联系人是欧阳锋先生。寄往上海市浦东新区世纪大道100号，谢谢",
        "plain words only, nothing here at all",
    ]


def python_pattern(rule):
    flags = re.IGNORECASE if rule.ignore_case else 0
    return re.compile(f"({rule.before})({rule.value})(?:{rule.after})", flags)


ALL = [*built_in_rules(), *extraction_name_rules()]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id bigint, text string").cache()


def test_java_matches_equal_python_matches(spark, corpus):
    """Raw matches before checks and post filters, for every rule."""
    from dataclasses import replace

    bare = [replace(r, check=None, post=(), order=i) for i, r in enumerate(ALL)]
    found = detect.explode_spans(detect.scan(corpus, bare, extraction=False)).select("doc_id", "ord", "start", "end", "text")
    actual = {tuple(r) for r in found.collect()}
    expected = set()
    for i, rule in enumerate(ALL):
        for doc, text in enumerate(texts()):
            for m in python_pattern(rule).finditer(text):
                expected.add((doc, i, m.start(2), m.end(2), m.group(2)))
    assert actual == expected
    assert len({o for _, o, *_ in expected}) > 45


def test_gates_are_necessary(spark):
    """A rule without its gate finds nothing more, on its own template and on all shared texts."""
    from dataclasses import replace

    shared = texts()
    templates = {key: _sql(case[0]) for key, case in CASES.items()}
    for rule in ALL:
        if rule.key not in templates:
            continue
        docs = spark.range(0, 60).selectExpr("id AS o_orderkey").selectExpr("o_orderkey AS doc_id", f"{templates[rule.key]} AS text")
        hits = [r for r in docs.collect() if python_pattern(rule).search(r["text"])]
        gated = docs.filter(detect.bound("text", detect.gate(rule, "g.text")))
        assert {r["doc_id"] for r in hits} <= {r["doc_id"] for r in gated.collect()}, rule.key
    assert all(replace(r, gate=(), gate_regex=None) for r in ALL) and shared


def test_fixture_spans(spark, corpus):
    rows = detect.explode_spans(arbitrate(detect.scan(corpus))).collect()
    found = {(r["doc_id"], r["type"], r["text"]) for r in rows}
    wanted = {
        (0, "CN_NAME", "张伟"), (0, "CN_PHONE_NUMBER", "13800138000"), (0, "EMAIL", "zhang.wei@example.com"),
        (1, "PRIVATE_PERSON", "John Smith"), (1, "PRIVATE_ADDRESS", "12 Main Street, Town"),
        (2, "PRIVATE_DATE", "5 mai 1990"),
        (3, "PRIVATE_PERSON", "Jörg Müller"), (4, "PRIVATE_PERSON", "Ana García"), (5, "PRIVATE_PERSON", "Иван Петров"),
        (6, "PRIVATE_PERSON", "山田太郎"), (7, "PRIVATE_PERSON", "홍길동"), (8, "PRIVATE_PERSON", "محمد علي"),
        (9, "PRIVATE_PERSON", "สมชาย ใจดี"), (10, "PASSWORD", "Abc123!!"), (11, "DATABASE_URI", "postgres://u:p@h.example.com/x"),
        (12, "IP_ADDRESS", "192.168.1.9"), (13, "CN_ID_CARD", "11010519491231002X"), (13, "CN_LICENSE_PLATE", "京A12345"),
        (14, "USERNAME", "bob_7"), (15, "PASSWORD", "abc def1"), (16, "CN_NAME", "王小明"), (16, "CN_NAME", "李四"),
        (16, "CN_NAME", "陈静"), (16, "CN_ADDRESS", "上海市浦东新区世纪大道100号"),
    }
    assert wanted <= found, wanted - found
    assert not [r for r in rows if r["doc_id"] == 17]
    for r in rows:
        assert texts()[r["doc_id"]][r["start"] : r["end"]] == r["text"]


def test_uri_wins_over_mail(spark, corpus):
    rows = detect.explode_spans(arbitrate(detect.scan(corpus))).filter("doc_id = 11 AND type = 'EMAIL'")
    assert rows.count() == 0


def test_negative_texts(spark):
    own = [
        "passwordManager syncs", "token_count >= 64", "version 10.2.3.4 is out", "id=550e8400-e29b-41d4-a716-446655440000",
        "用户名是登录身份的一部分", "张贴公告", "build 2026.09.13-08", "getPassword() returns None", "1700000000 and 1800000000",
    ]
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id bigint, text string")
    assert detect.explode_spans(detect.scan(docs)).collect() == []


def test_conversations_hold_nothing(spark, data):
    assert detect.detect_rules(scan_texts(spark, data, "conversations")).count() == 0


def test_signs_and_capitals_are_necessary(spark, corpus):
    """A rule finds the same without what it says of signs and capitals, and texts without them never reach its literals."""
    from dataclasses import replace

    told = [r for r in built_in_rules() if r.signs or r.caps]
    assert {"B42", "B38", "B21"} <= {r.key for r in told}
    cases = [spark.range(0, 40).selectExpr("id AS o_orderkey").selectExpr(f"{_sql(CASES[r.key][0])} AS text") for r in told if r.key in CASES]
    docs = corpus.select("text")
    for case in cases:
        docs = docs.unionByName(case)
    docs = docs.selectExpr("xxhash64(text) AS doc_id", "text").distinct().cache()
    find = lambda rules: {tuple(r) for r in detect.explode_spans(detect.scan(docs, rules, extraction=False)).select("doc_id", "ord", "start", "text").collect()}
    found = find(told)
    assert found == find([replace(r, signs="", caps=False) for r in told]) and len({x[1] for x in found}) > 15
    plain = spark.createDataFrame([("the password is a secret token of the account",), ("Key ARN",)], "text string")
    open_ = [[r.key for r in told if x[r.key]] for x in plain.select(*[F.expr(detect.bound("text", detect.gate(r, "g.text"))).alias(r.key) for r in told]).collect()]
    assert open_ == [[], []]
