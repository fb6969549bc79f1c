"""The chunker against a plain statement of its rules."""

import random

import pytest

from blastradius.operators import chunks as C


def plain(body, starts, most):
    """Rules as they are told: whole, else from line to line that starts a piece, else the last line end that fits."""
    if len(body) <= most:
        return [body] if body else []
    at, offset = [0], 0
    for line in body.split("\n"):
        if line.strip().lower().startswith(starts):
            at.append(offset)
        offset += len(line) + 1
    at = sorted({*at, len(body)})
    out = []
    if len(at) > 2:
        for a, b in zip(at, at[1:], strict=False):
            out += [body[i : min(i + most, b)] for i in range(a, b, most)]
        return out
    while body:
        piece = body[:most]
        if len(body) > most and "\n" in piece[1:]:
            piece = piece[: piece.rindex("\n") + 1]
        out.append(piece)
        body = body[len(piece) :]
    return out


@pytest.mark.parametrize("language, starts", [("python", ("def test", "class test", "@pytest")), ("java", ("@test", "public void test", "@beforeeach", "@aftereach")), ("x", ("def test", "function test", "public void test"))])
def test_cuts_are_the_rules(language, starts):
    r = random.Random(language)
    lines = ["def test_a():", "  @Test", "class TestX:", "x = 1", "", "function testIt()", "é" * 9, "public void testY()", "    @pytest.fixture"]
    for _ in range(3000):
        body = "\n".join(r.choice(lines) * r.choice([1, 1, 3]) for _ in range(r.randrange(9)))
        most = r.randrange(1, 60)
        got = [body[a:b] for _, a, b in C.cuts(body, language, most)]
        assert got == plain(body, starts, most) and "".join(got) == body


def test_chunk_rows(spark):
    long = "line one\n" * 500
    rows = [(1, "python", "import x\ndef test_a():\n    pass\n" + "# x\n" * 600), (2, None, long), (3, "python", ""), (4, "java", None), (5, "javascript", "it('a', () => {})")]
    df = spark.createDataFrame(rows, "file_id long, language string, body string")
    got = C.chunk(df).orderBy("file_id", "chunk_no").collect()
    for i, _, body in rows:
        assert "".join(r.content for r in got if r.file_id == i) == (body or "")
    assert {r.file_id: r.chunk_type for r in got} == {1: "method_boundary_split", 2: "character_split", 5: "single"}
    assert [r.method_name for r in got if r.file_id == 5] == ["a"] and got[1].method_name == "test a"
    assert [(r.start_line, r.end_line) for r in got if r.file_id == 2][:2] == [(1, 223), (223, 445)]
    assert C.chunk(df.limit(0)).count() == 0
