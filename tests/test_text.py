"""Facts about parsing: records as they arrive, field by field."""

import ipaddress

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sentrylake.config import RISK_WEIGHTS, BadSettings, Settings, weights_of_file
from sentrylake.functions import text as X
from sentrylake.plans.session import prepare


def value(spark, make, *args):
    prepare(spark)
    names = [f"c{i}" for i in range(len(args))]
    row = spark.createDataFrame([args], ", ".join(f"{n} string" for n in names))
    return row.select(make(*map(F.col, names)).alias("v")).first().v


def test_kv_map(spark):
    line = 'type=SYSCALL  a="x y" key="k"\x1dARCH=x86 b=1 b=2 =no plain c= d=\'q\' e=f=g'
    got = value(spark, X.kv_map, line)
    assert got == {"type": "SYSCALL", "a": "x", "key": "k", "ARCH": "x86", "b": "2", "c": "", "d": "q", "e": "f=g"}


def test_python_white_space_separates(spark):
    assert value(spark, X.kv_map, "a=1\x85b=2\xa0c=3\x1cd=4") == dict(zip("abcd", "1234", strict=True))


def test_stamps_and_ids(spark):
    assert value(spark, lambda c: F.concat_ws("|", *X.audit_stamp(c)), "type=BPF msg=audit(1785459648.235:4258): x") == "1785459648.235|4258"
    make = lambda raw, iso, seq: X.event_id(raw, iso, seq)
    assert value(spark, make, "msg=audit(1785459648.2:42):", None, "7") == "1785459648.200:42"
    assert value(spark, make, "", "2026-01-01T00:00:00+00:00", "42") == "2026-01-01T00:00:00+00:00:42"
    assert value(spark, make, "", None, "42") == "42" and value(spark, make, "", "t", None) is None


@pytest.mark.parametrize(("given_", "want"), [("2f62696e2f6c73", "/bin/ls"), ("6c73002d6c61", "ls -la"), ("abc", "abc"), ("/bin/ls", "/bin/ls"), ("cafe", "�"), ("", ""), (None, None), (" 6c73 ", " 6c73 ".strip() and "ls")])
def test_hex_decode(spark, given_, want):
    got = value(spark, X.hex_decode, given_)
    assert got == want or given_ == "cafe" and "�" in got


def test_control_characters(spark):
    assert value(spark, X.proctitle, "sudo^@su\x00 -") == "sudo su -"
    assert value(spark, X.strip_control, "\x01 ^A ") is None


def test_ids_and_names(spark):
    assert [value(spark, X.to_id, v) for v in ("5", "x", None, "-1", "4294967295")] == [5, -1, -1, -1, -1]
    assert [value(spark, X.clean_name, v) for v in ("root", " UNSET", "?", "", None)] == ["root", None, None, None, None]
    assert [value(spark, X.basename, v) for v in ("/usr/bin/ls", "ls", "/a/b/", "/", None)] == ["ls", "ls", "b", None, None]
    assert value(spark, X.clean_key, 'priv"\x1dARCH=x') == "priv" and value(spark, X.clean_key, "(null)") == "(null)"


def test_success_falls_through_to_the_next_source(spark):
    make = lambda a, b: X.success(F.create_map(F.lit("success"), a), F.create_map(F.lit("res"), b))
    assert value(spark, make, "maybe", "failed") is False and value(spark, make, "YES", "failed") is True
    assert value(spark, make, "", "?") is None


def test_socket_addresses(spark):
    get = lambda h: tuple(value(spark, X.socket_address, h))
    assert get("0200115ccb0071040000000000000000") == ("203.0.113.4", 4444)
    assert get("0200115c") == (None, -1) and get("zz") == (None, -1) and get("0100" + "0" * 60) == (None, -1)
    for address in ("::", "::1", "fe80::1:0:0:1", "2001:db8::8:800:200c:417a", "1:0:2:0:3:0:4:0", "1:2:3:4:5:6:7:8", "0:0:1::"):
        a = ipaddress.IPv6Address(address)
        assert get("0a00115c00000000" + a.packed.hex() + "00000000") == (str(a), 4444)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from([0, 0, 0, 1, 0xAB, 0xFFFF]), min_size=8, max_size=8))
def test_ipv6_text_is_the_standard_one(spark, parts):
    a = ipaddress.IPv6Address(b"".join(p.to_bytes(2, "big") for p in parts))
    assert value(spark, X.socket_address, "0a00115c00000000" + a.packed.hex() + "00000000").ip == str(a)


def test_arguments_stop_at_the_first_gap(spark):
    make = lambda c: X.execve_args(X.kv_map(c))
    assert value(spark, make, 'a0="ls" a1=2d6c61 a3=no') == ["ls", "-la"]
    assert value(spark, make, "x=1") == []


def test_private_addresses(spark):
    assert [value(spark, X.is_private, ip) for ip in ("10.1.1.1", "172.99.1.1", "fd00::1", "203.0.113.9", "127.0.0.1")] == [True, True, True, False, True]


def test_iso_text_drops_an_empty_fraction(spark):
    make = lambda c: X.iso_text(F.try_to_timestamp(c))
    assert value(spark, make, "2026-07-14T23:27:29.162Z") == "2026-07-14T23:27:29.162000+00:00"
    assert value(spark, make, "2026-07-14T23:27:29Z") == "2026-07-14T23:27:29+00:00" and value(spark, make, "never") is None


def test_bands_and_small_text(spark):
    assert [value(spark, lambda c: X.band(c.cast("int")), str(n)) for n in (100, 80, 79, 60, 40, 20, 19)] == ["critical", "critical", "high", "high", "medium", "low", "informational"]
    assert value(spark, X.title_words, "USER_AUTH") == "User_Auth"
    assert value(spark, lambda c: X.rounded(c.cast("double"), 1), "33.3333") == 33.3
    assert value(spark, lambda c: X.bar(c.cast("double"), 10), "0.3") == "###-------"
    assert value(spark, X.search_tokens, "It's v1.2, sudo_x!") == ["it's", "v1.2", "sudo_x"]


def test_settings(tmp_path):
    (tmp_path / "w.json").write_text('{"context_modifier": {"max": 0.3}}')
    got = Settings.read({"SENTRYLAKE_TREES": "7", "SENTRYLAKE_SAMPLE": " ", "SENTRYLAKE_THRESHOLD": "x", "SENTRYLAKE_HOSTS": '{"h": 1}', "SENTRYLAKE_WEIGHTS": str(tmp_path / "w.json")})
    assert (got.trees, got.sample, got.threshold, got.hosts) == (7, 4096, 0.98, {"h": 1.0})
    assert got.weights["context_modifier"]["max"] == 0.3 and got.weights["context_modifier"]["min"] == RISK_WEIGHTS["context_modifier"]["min"]
    assert len(got.problems) == 1 and got.problems[0].startswith("SENTRYLAKE_THRESHOLD: ")
    assert Settings.read({}).weights == RISK_WEIGHTS and not Settings.read({}).problems
    (tmp_path / "bad.json").write_text('{"impact": {"size": 1, "privilege": "x"}}')
    for name, text in (("HOSTS", "{"), ("HOSTS", '{"h": 2}'), ("HOSTS", "[]"), ("WEIGHTS", str(tmp_path / "absent.json")), ("WEIGHTS", str(tmp_path / "bad.json"))):
        got = Settings.read({f"SENTRYLAKE_{name}": text})
        assert len(got.problems) == 1 and got.weights == RISK_WEIGHTS and got.hosts == {}
    with pytest.raises(BadSettings, match="impact.size is unknown; impact.privilege is no number"):
        weights_of_file(str(tmp_path / "bad.json"))
