import uuid

import pytest
from pyspark.sql import functions as F

from ticketloom import constants as K
from ticketloom.functions import text as X
from ticketloom.operators import classify


def apply(spark, fn, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["o"] for r in rows.select("i", fn(F.col("t")).alias("o")).orderBy("i").collect()]


def test_transfer_text_variants(spark):
    base = K.TRANSFER_TEXTS[0]
    html = "<p>" + base.replace("Hàng.Vui", "Hàng.</p><p>Vui") + "</p>"
    entity = base.replace("ỗ", "&#7895;").replace("à", "&agrave;").replace(" ", "&nbsp;")
    wide = base.replace("X", "Ｘ").upper()
    values = [base, html, base.replace("Hàng.Vui", "Hàng.\nVui"), "  " + base + "\n", entity, wide, base + "x", "Xin lỗi", None]
    assert apply(spark, classify.is_transfer_response, values) == [True] * 6 + [False] * 3


@pytest.mark.parametrize("raw,want", [
    ("Mã 123456789", "Mã [PII]"), ("Mã 12345678901234567890", "Mã [PII]"), ("Email person.name+tag@example.com", "Email [PII]"),
    ("Mở https://example.com/private?a=1", "Mở [PII]"), ("Mở WWW.example.com/path", "Mở [PII]"), ("Thẻ 4111 1111 1111 1111", "Thẻ [PII]"),
    ("Thẻ 5500-0000-0000-0004", "Thẻ [PII]"), ("12345678 123456789012345678901", "12345678 123456789012345678901"),
    ("Nguyễn Văn An cần kiểm tra", "Nguyễn Văn An cần kiểm tra")])
def test_mask_patterns(spark, raw, want):
    assert apply(spark, X.mask_text, [raw]) == [want]


def test_mask_known_values_longest_first_and_length(spark):
    rows = spark.createDataFrame([("ab abc x", ["ab", "abc", "", None])], "t string, v array<string>")
    assert rows.select(X.mask_text(F.col("t"), F.col("v"))).first()[0] == "[PII] [PII] x"
    long = "x" * 4000 + " person@example.com"
    assert len(apply(spark, X.mask_text, [long])[0]) == 4000


def test_mask_digit_runs(spark):
    assert apply(spark, X.mask_digit_runs, ["a 123456789 b", "12345678", "1234567890x12"]) == ["a ********* b", "12345678", "**********x12"]


def test_redact_comment(spark):
    got = apply(spark, X.redact_comment, [
        "Nguyễn Văn An hỗ trợ tốt", "xử lý nhanh", "lý do chậm", "gọi 0901234567 nhé", "mail a@b.vn", "le hoi vui", "Lê Thị Hoa", "   ", None, "anh Trần Bình ok", "x" * 300])
    assert got == ["[đã ẩn] hỗ trợ tốt", "xử lý nhanh", "lý do chậm", "gọi [đã ẩn] nhé", "mail [đã ẩn]", "le hoi vui", "[đã ẩn]", None, None, "anh [đã ẩn] ok", "x" * 200]


def test_safe_string(spark):
    got = apply(spark, X.safe_string, ["  Nạp tiền ", "gọi 0901234567", "a@b.vn x", "http://x", "mã 123456", "Nguyễn Văn An", "x" * 257, " ", "a​b", "é"])
    assert got == ["Nạp tiền", None, None, None, None, None, None, None, None, "é"]


def test_looks_like_person(spark):
    got = apply(spark, X.looks_like_person, ["Nguyễn Văn An", "Bot An", "An", "Hỗ Trợ Khách", "Mai-Anh Lê", "A1 Lê", "a b c d e f g", "Đội CS"])
    assert got == [True, False, False, False, True, False, False, False]


def test_ids_and_intents(spark):
    assert apply(spark, X.is_safe_ticket_id, ["123", "0123", "84901234567", "1" * 20, "1" * 21, "12a"]) == [True, False, False, True, False, False]
    assert apply(spark, X.is_safe_intent, ["refund_1", "Refund", "a123456", "x" * 65, None]) == [True, False, False, False, False]
    assert apply(spark, X.safe_skill, ["customer-service/topup", "topup", "A", "0901234567", "x123456"]) == ["topup", "topup", None, None, None]


def test_private_identifiers(spark):
    got = apply(spark, X.has_private_identifier, ["０９０ 123 45 67", "090-123-4567", "hello 12", "123e4567-e89b-42d3-a456-426614174000", "8​4901234567"])
    assert got == [True, True, False, True, True]


def test_uuid5(spark):
    names = ["a|b|c", "xin chào", ""]
    assert apply(spark, X.uuid5_url, names) == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_accent_fold_and_natural_key(spark):
    assert apply(spark, X.accent_fold, ["Nạp TIỀN", "Đỗ"]) == ["nap tien", "đo"]
    keys = apply(spark, X.natural_key, ["app 10", "app 9", "2 x", "App 9b"])
    order = sorted(range(4), key=lambda i: keys[i])
    assert order == [2, 1, 3, 0]


def test_strip_title_suffix(spark):
    assert apply(spark, X.strip_title_suffix, ["Lỗi ( Mã giao dịch: 12 ) -  ( Ticket id: 3 )", "Lỗi", None]) == ["Lỗi", "Lỗi", ""]
