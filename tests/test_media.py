from seriesloom.sources import documents


def test_media_of_all_kinds_are_found(spark, tmp_path):
    """The 29 suffixes of the reference's media list, and no others."""
    kinds = "264 265 av1 avc avi flv hevc iso m2ts m2v m4v mkv mov mp2 mp4 mpe mpeg mpg mpv mts ogm qv rm rmvb ts vob webm wmv yuv".split()
    for k in [*kinds, "ivf", "y4m", "avs", "vpy", "txt"]:
        (tmp_path / f"a.{k}").write_bytes(b"x")
    assert sorted(r.name for r in documents.discover_media(spark, f"file://{tmp_path}").collect()) == [f"a.{k}" for k in kinds]
