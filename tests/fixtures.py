"""A small annotated document and its resources, written for these tests."""

HEAD = "doc_id={d} page=1 block_id={b} bbox=1.0,2.0,3.0,4.0 label=tb {s} {e}"


def line(n, text, **attrs):
    attrs = {"tag": "O"} | attrs
    return f"line={n} " + " ".join(f"{k}={v}" for k, v in attrs.items()) + f" fonts=F1-9.0 bbox=1.0,-2.5,3.0,4.0 iscore=0.25 :{text}"


def document(d="d1"):
    one = [line(1, "  Of Old Norse, Norse and Zulu we speak; and of Tuki-"), line(2, "sano with some care."), line(3, "East-"), line(4, "   (West) grammar, by Diné or Dine speakers")]
    two = [line(5, "Zulu again", tag="M"), line(6, "  ni  ka-ta ", tag="L", span_id="s1", lang_code="zul", lang_name="Zulu"), line(7, " gloss Zulu", tag="G", span_id="s1", lang_code="zul", lang_name="Zulu"),
           line(8, "plain"), line(9, "ta ta", tag="T+AL", span_id="s2", lang_code="non:nrs", lang_name="Old Norse"), line(10, "Norse", tag="T", span_id="s2", lang_code="non:nrs", lang_name="Old Norse")]
    return "\n".join([HEAD.format(d=d, b="1-1", s=1, e=4), *one, "", HEAD.format(d=d, b="1-2", s=5, e=10), *two, ""])


GAZETTEER = [("norse", "non"), ("old norse", "non"), ("zulu", "zul"), ("zulu", "zux"), ("tukisano", "tks"), ("east-west", "eaw"), ("dine", "nav")]

#: All mentions: startline, startcol, endline, endcol, name, code, text
MENTIONS = [
    (1, 5, 1, 14, "old norse", "non", "Old Norse"), (1, 9, 1, 14, "norse", "non", "Norse"), (1, 16, 1, 21, "norse", "non", "Norse"), (1, 26, 1, 30, "zulu", "zul", "Zulu"), (1, 26, 1, 30, "zulu", "zux", "Zulu"),
    (1, 48, 2, 4, "tukisano", "tks", "Tuki-sano"), (4, 22, 4, 26, "dine", "nav", "Diné"), (4, 30, 4, 34, "dine", "nav", "Dine"),
    (5, 0, 5, 4, "zulu", "zul", "Zulu"), (5, 0, 5, 4, "zulu", "zux", "Zulu"), (7, 7, 7, 11, "zulu", "zul", "Zulu"), (7, 7, 7, 11, "zulu", "zux", "Zulu"), (10, 0, 10, 5, "norse", "non", "Norse"),
]
