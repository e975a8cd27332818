"""The command line: groups, inheritance, and each option against plain arrays."""

import numpy as np
import pytest

from gridspark import cli
from gridspark.functions import expr
from gridspark.model import Dataset
from gridspark.sources import registry

A = np.arange(24.0).reshape(2, 3, 4)


@pytest.fixture(scope="module")
def paths(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("cli")
    lat, lon = np.array([10.0, 20.0, 30.0]), np.array([-5.0, 0.0, 5.0, 10.0])
    for name, k in (("a", 1), ("b", 10)):
        ds = Dataset.from_arrays(spark, {"o3": A * k, "w": A % 3 + 1, "lat": lat, "lon": lon}, {"o3": ("time", "lat", "lon"), "w": ("time", "lat", "lon"), "lat": ("lat",), "lon": ("lon",)}).set_coords("lat", "lon")
        registry.save(ds, f"file://{d}/{name}")
    return f"file://{d}/a", f"file://{d}/b", d


def _run(spark, *argv):
    return cli.datasets(spark, argv)[0]


def test_groups(spark, paths):
    a, b, _ = paths
    one, two = _run(spark, a, "-v", "o3", "-s", "lat,0,2", "--sep", b, "-r", "time,mean")
    assert (one.to_numpy("o3") == A[:, :2]).all() and set(one.data_vars()) == {"o3"}
    assert np.allclose(two.to_numpy("o3"), 10 * A.mean(0)[None])
    (diff,) = _run(spark, b, "-v", "o3", "--sep", a, "-v", "o3", "--sep", "--op-typ=-", "--expr", "o3 = o3 / 9")
    assert np.allclose(diff.to_numpy("o3"), A)
    one, two = _run(spark, a, "-v", "o3", "-s", "time,1", "--inherit", "--sep", b, "--sep", a, "-s", "lat,0")[:2]
    assert two.dims["time"] == 1 and (two.to_numpy("o3") == 10 * A[1:]).all()
    (stacked,) = _run(spark, a, b, "--stack", "time")
    assert stacked.dims["time"] == 4
    (merged,) = _run(spark, a, "-v", "o3", "--sep", a, "-v", "w", "--sep", "--merge")
    assert set(merged.data_vars()) == {"o3", "w"}


def test_options(spark, paths, tmp_path):
    a, b, _ = paths
    (m,) = _run(spark, a, "-m", "greater,10", "-m", "where,o3 < 3")
    assert (np.ma.getmaskarray(m.to_numpy("o3")) == ((A > 10) | (A < 3))).all()
    (x,) = _run(spark, a, "-a", "units,o3,o,c,ppb", "-a", "level,global,c,l,7", "-a", "level,global,d")
    assert x.vars["o3"].attrs["units"] == "ppb" and "level" not in x.attrs
    (w,) = _run(spark, a, "-v", "o3,w", "-r", "lat,mean,w")
    weight = A % 3 + 1
    assert np.allclose(w.to_numpy("o3"), ((A * weight).sum(1) / weight.sum(1))[:, None])
    (f,) = _run(spark, a, "-v", "o3", "--mesh", "lon,0.5,mean")
    assert f.dims["lon"] == 8
    (p,) = _run(spark, a, "-v", "o3", "-e", "4,21/-6,9/9.9,31")
    assert (p.to_numpy("o3") == np.stack([A[:, 1, 2], A[:, 0, 0], A[:, 2, 3]], axis=1)).all() and p.vars["o3"].dims == ("time", "POINTS")
    script = tmp_path / "s.txt"
    script.write_text("# halves\nhalf = 1 / 2\nh = o3 * half\nq = h * half\n")
    (s,) = _run(spark, a, "--exprscript", str(script))
    assert (s.to_numpy("q") == A / 4).all() and set(s.data_vars()) == {"h", "q"}
    with pytest.warns(UserWarning, match="no such variable"):
        (k,) = _run(spark, a, "-v", "o3*2,none,w")
    assert set(k.data_vars()) == {"o3_2", "w"} and (k.to_numpy("o3_2") == 2 * A).all()


def test_actions(spark, paths, tmp_path, capsys):
    a, b, _ = paths
    cli.run(spark, ["gen", a, "-v", "o3", "--sep", b, "-v", "w", "-o", f"file://{tmp_path}/out"])
    back = registry.open_dataset(spark, f"file://{tmp_path}/out")
    assert set(back.data_vars()) == {"o3", "w"}
    cli.run(spark, ["dump", a])
    assert "o3(time, lat, lon)" in capsys.readouterr().out
    assert cli.run(spark, ["eval", a, "-v", "o3", "--sep", b, "-v", "o3", "--expr", "o3 = o3 / 10", "--funcs", "MB,NOP"]) == [("o3", "MB", 0.0), ("o3", "NOP", 24)]
    for bad in (["gen"], ["show", a], ["eval", a], ["gen", a, "--op-typ", "+"]):
        with pytest.raises(ValueError):
            cli.run(spark, bad)


def test_own_functions(spark, paths):
    ds = registry.open_dataset(spark, paths[0])
    out = expr.evaluate(ds, "z = twice(o3) + shift", constants={"shift": 3}, functions={"twice": lambda c: c * 2})
    assert (out.to_numpy("z") == 2 * A + 3).all()
    with pytest.raises(ValueError):
        expr.evaluate(ds, "z = 3")
