"""Every command on small folders, in the order in which a user would run them."""

import numpy as np
import pytest

from sightline.__main__ import main, parser
from sightline.functions import imaging as I
from sightline.sources import codecs

from .test_detect import XML, scene


def test_commands(spark, tmp_path, capsys):
    frames, faces, out = tmp_path / "frames", tmp_path / "faces", tmp_path / "out"
    frames.mkdir()
    for k in range(4):
        (frames / f"frame_{k + 1:06d}.pgm").write_bytes(codecs.write_pgm(scene(10, 10)))
    (tmp_path / "cascade.xml").write_text(XML)
    scan = ["--cascade", str(tmp_path / "cascade.xml"), "--min-size", "12", "--max-size", "16", "--step", "1", "--min-neighbors", "2"]
    main(["detect", str(frames), str(out), *scan, "--track", "--crops"], spark)
    assert len(list((out / "crops").iterdir())) == 4 and "4 frames" in (out / "report.html").read_text()
    (tmp_path / "labels.txt").write_text("# who is who\n0: Ann\n")
    main(["name", str(out / "tracks"), str(tmp_path / "labels.txt"), str(tmp_path / "named")], spark)
    main(["collect", str(tmp_path / "named"), str(frames), str(tmp_path / "people"), "--per-track", "2"], spark)
    assert len(list((tmp_path / "people" / "Ann").iterdir())) == 2
    rng = np.random.default_rng(3)
    for person in ("ann", "bob"):
        (faces / person).mkdir(parents=True)
        base = rng.integers(0, 256, (14, 12), dtype=np.uint8)
        for k in range(3):
            noisy = np.clip(base.astype(int) + rng.integers(-9, 9, base.shape), 0, 255).astype(np.uint8)
            (faces / person / f"{k}.pgm").write_bytes(codecs.write_pgm(I.resize_bilinear(noisy, 92, 112)))
    for algorithm, told in (("eigenfaces", "components of 10304 dimensions, 6 samples of 2 classes"), ("lbph", "texture histograms, 6 samples of 2 classes")):
        model = str(tmp_path / algorithm)
        main(["train", str(faces), model, "--algorithm", algorithm, "--components", "3"], spark)
        main(["info", model], spark)
        assert told in capsys.readouterr().out
        main(["recognise", model, str(faces / "bob"), str(tmp_path / f"found-{algorithm}")], spark)
        lines = [r.value.split("\t") for r in spark.read.text(str(tmp_path / f"found-{algorithm}")).collect()]
        assert len(lines) == 3 and {x[1] for x in lines} <= {"bob", "unknown"} and (algorithm != "eigenfaces" or {x[1] for x in lines} == {"bob"})
    main(["benchmark", str(faces), "--algorithm", "lbph", "--folds", "3", "--mode", "id"], spark)
    assert "| lbph |" in capsys.readouterr().out


def test_options():
    with pytest.raises(SystemExit):
        parser().parse_args(["detect", "in", "out"])  # a cascade must be named
    assert parser().parse_args(["benchmark", "faces"]).folds == 5
