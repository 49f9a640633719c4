import pytest

from veilscan.functions.structured import extract, page_text, render, supplement


def test_json_records_stand_apart():
    text, why = render('{"mrn": "A1", "n": 1.5, "rows": [{"d": "x"}, {"d": null}], "s": "{\\"k\\": 1}"}', "json")
    assert (text, why) == ('"mrn": A1 | "n": 1.5\f"d": x\f"d": null\f"k": 1', None)


@pytest.mark.parametrize("text", ['{"a": 1, "a": 2}', "{", "[" * 80 + "]" * 80, '<!DOCTYPE x><a b="1"/>'])
def test_unsafe_input_is_cut_at_every_delimiter(text):
    shown, why = render(text, "xml" if text[0] == "<" else "json")
    assert why == "structured_record_boundaries_unverified" and "{" not in shown


def test_xml_records():
    assert render('<p id="1">t<a>x</a><b>1</b><b>2</b>tail</p>', "xml") == ("id: 1 | p: t | a: x\fb: 1\fb: 2\ftail", None)


def test_jsonl_and_limits():
    assert render('{"a": 1}\n\n{"a": 2}', "jsonl") == ('"a": 1\f"a": 2', None)
    assert render('{"a": "' + "x" * 50 + '"}', "json", 20)[1] == "structured_text_limit_reached"


def test_tables_keep_the_header_row():
    assert extract(b"mrn,note\nA1,fine\nB2,ill,more\n", ".csv")[0] == "mrn: mrn | note: note\fmrn: A1 | note: fine\fmrn: B2 | note: ill | field: more".replace("mrn: mrn | note: note", "mrn | note")
    text, status, reason, _, _, linkage = extract(b'mrn,payload\nA1,"{bad"\n', ".csv")
    assert (status, reason, linkage) == ("partial", "csv_structured_cell_boundaries_unverified", False) and "A1" in text


@pytest.mark.parametrize(
    ("data", "suffix", "status", "reason"),
    [(b"x", ".zip", "excluded", "archive_scanning_disabled"), (b"x", ".dcm", "unsupported", "unsupported_file_format"), (b"x", ".pdf", "unsupported", "tika_not_configured"), (b"a\0b", ".txt", "unsupported", "binary_content_in_text_file"), (b"\xff\xfea\0", ".txt", "full", None), (b"\xfa", ".txt", "partial", "encoding_replacement"), (None, ".txt", "full", None)],
)
def test_status(data, suffix, status, reason):
    assert extract(data, suffix)[1:3] == (status, reason)


def test_segments_of_messages_and_bounds():
    assert extract(b"MSH|1\rPID|2", ".hl7")[0] == "MSH|1\fPID|2"
    assert extract(b"abcdef", ".txt", 3)[:3] == ("abc", "partial", "text_limit_reached")


def test_pages():
    assert page_text("<html><head><title>t</title></head><body><p>a&amp;b</p><table><tr><td>1</td></tr></table><script>x</script></body></html>").split() == ["a&b", "1"]
    assert supplement(["a  b", "c"], ["a b"]) == ["c"]
