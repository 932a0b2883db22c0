"""What is found as personal data, what stays, and texts that try the patterns."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gridseek.llm import pii

VALUES = [
    "4111111111111111", "5500 0055 5555 5559", "+1 (456) 555-2186", "212-555-0187", "+1 (017) 555-7713", "(012) 155-7713", "+44 20 7946 0958", "+372 5123 4567", "+86-138-0013-8000",
    "123-45-6789", "899-01-0001", "8.8.4.4", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "fe80:1:2::8a2e:370", "2024-02-29", "31.12.1999", "12/31/1999", "02-28-2001",
    "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "jo.doe+x@mail.example.com",
]
STAY = ["000-12-3456", "666-12-3456", "912-12-3456", "123-00-4567", "123-45-0000", "4111111111111112", "2024-02-30", "13/32/1999", "300.1.1.1", "GB83 WEST 1234 5698 7654 32", "12:34:56", "std::vector", "017-555-7713", "key 0123456789abcdef", "@handle", "1.2.3", "$100", "+12", "word"]
SECRETS = ['token = "0123456789abcdef0123456789abcdef01234567"', "API_KEY: sk-AbCdEf0123456789xyz", "password='hunter2hunter2hunter2'"]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_what_is_found(spark):
    """Texts are put together from values and from what looks alike; each value goes, and all else stays byte by byte."""
    rng = random.Random(3)
    texts, want = [], []
    for _ in range(120):
        parts = [(rng.choice(VALUES), True) if rng.random() < 0.4 else (rng.choice(STAY), False) for _ in range(rng.randint(0, 8))]
        texts.append(" | ".join(p for p, _ in parts))
        want.append(parts)
    got = {r.doc_id: r for r in pii.pseudonymized(frame(spark, texts), "k").collect()}
    image = {}
    for i, parts in enumerate(want):
        assert got[i].n_found == sum(v for _, v in parts), texts[i]
        for (old, value), new in zip(parts, got[i].text.split(" | ") if parts else []):
            assert (old != new) == value
            assert image.setdefault(old, new) == new  # equal values stay linked
            if value and "@" not in old and "." not in old:
                assert re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub(r"\d", "9", new))) == re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub(r"\d", "9", old)))
    assert len({image[v] for v in image if v in VALUES}) == len([v for v in image if v in VALUES])


def test_values_come_back_with_the_key(spark):
    values = [v for v in VALUES if "@" not in v] + [s.split(" ")[-1].strip("\"'") for s in SECRETS[:2]]
    values += [f"{m:02d}/{d:02d}/{y}" for y in (1900, 2000, 2099) for m in (1, 2, 12) for d in (13, 28)]
    new = frame(spark, values).select("doc_id", "text", pii.pseudonym(F.col("text"), F.lit("k")).alias("new"))
    back = new.select("doc_id", "new", pii.pseudonym(F.col("new"), F.lit("k"), inverse=True).alias("back")).collect()
    assert {r.doc_id: r.back for r in back} == dict(enumerate(values))
    assert len({r.new for r in back}) == len(set(values))
    iban = next(r.new for r in back if r.doc_id == values.index("DE89370400440532013000"))
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    ssn = [r.new for r in back if re.fullmatch(r"\d{3}-\d\d-\d{4}", r.new)]
    assert len(ssn) == 2 and not any(re.match("000|666|9", x) or x[4:6] == "00" or x[7:] == "0000" for x in ssn)


def test_days_with_the_month_first_are_permuted_one_to_one(spark):
    days = spark.sql("select date_format(d, 'MM/dd/yyyy') as d from (select explode(sequence(date'1900-01-01', date'2099-12-31')) as d) where dayofmonth(d) > 12")
    new = days.select("d", pii.pseudonym(F.col("d"), F.lit("k")).alias("p"))
    assert new.select("p").distinct().count() == days.count() == 73049 - 28800
    assert new.where(F.substring("p", 4, 2).cast("int") < 13).count() == 0


def test_social_security_numbers_are_permuted_one_to_one(spark):
    areas = spark.range(1, 900).where("id != 666").select(F.format_string("%03d-12-3456", "id").alias("v"))
    assert areas.select(pii.pseudonym(F.col("v"), F.lit("k")).alias("p")).distinct().count() == 898


def test_secrets(spark):
    got = [r.text for r in pii.pseudonymized(frame(spark, [f"x {s} y" for s in SECRETS] + ["token = short", "tokens are 0123456789abcdef0123"]), "k").orderBy("doc_id").collect()]
    for old, new in zip(SECRETS, got):
        assert new != f"x {old} y" and len(new) == len(old) + 4 and re.split("[=:]", new)[0] == re.split("[=:]", f"x {old} y")[0]
    assert re.fullmatch(r'x token = "[0-9a-f]{40}" y', got[0]) and got[3:] == ["token = short", "tokens are 0123456789abcdef0123"]


@pytest.mark.parametrize("body", [".c", "1 ", "1-", "1.", "a@", "a@b.c", "a:", "1:", "+1 ", "(012) ", "AB12 ", "12/", "token=", "0" * 7])
def test_no_text_exhausts_the_stack(spark, body):
    text = "a@b" + body * 100_000
    got = pii.pseudonymized(frame(spark, [text, "8.8.4.4"]), "k").collect()
    assert len(got) == 2 and all(r.text for r in got)


def test_the_key_is_not_in_the_plan(spark):
    plan = pii.pseudonymized(frame(spark, ["8.8.4.4"]), "a-very-secret-key")._jdf.queryExecution().toString()
    assert "a-very-secret-key" not in plan
