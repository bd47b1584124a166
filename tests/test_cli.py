from seqlake import cli


def text(folder):
    return sorted(line for p in folder.glob("part-*") for line in p.read_text().split("\n") if line)


def test_commands(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">x one\nAACG\n>y\naacg\n")
    run = lambda *args: cli.main([*map(str, args)], spark)
    run("reverse_complement", tmp_path / "a.fasta", "--out", tmp_path / "rc")
    assert text(tmp_path / "rc") == [">x one", ">y", "CGTT", "CGTT"]
    run("rlencode", tmp_path / "a.fasta", "--out", tmp_path / "rle")
    run("rldecode", tmp_path / "rle", "--out", tmp_path / "back")
    assert text(tmp_path / "back") == [">x one", ">y", "AACG", "AACG"]
    run("dedup", tmp_path / "a.fasta", "--out", tmp_path / "d")
    assert text(tmp_path / "d" / "weights") == ["kept,weight", "x,2"]
    (tmp_path / "a.csv").write_text("k,v\n1,x\n1,y\n")
    run("csvdeduplicate", tmp_path / "a.csv", "--on", "k", "--last", "--out", tmp_path / "l")
    assert text(tmp_path / "l") == ["1,y", "k,v"]
    run("csvmod", tmp_path / "a.csv", "--add", "z:3", "--out", tmp_path / "m")
    assert "1,x,3" in text(tmp_path / "m")
