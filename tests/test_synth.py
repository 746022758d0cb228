from faultline import synth
from faultline.operators.detectors import DETECTORS, signals
from faultline.operators.steps import enrich


def test_every_detector_fires_on_its_fault_and_none_on_clean_runs(spark):
    runs = {f"clean-{s}": (*synth.clean_run(s), "success") for s in range(20)}
    truth = {}
    for kind in synth.INJECTORS:
        for seed in (1, 2):
            goal, steps, at = synth.faulty_run(seed, kind)
            runs[f"{kind}-{seed}"], truth[f"{kind}-{seed}"] = (goal, steps, "failure"), at
    got = [(r.trace_id, r.detector, r.step_index) for r in signals(enrich(*synth.tables(spark, runs))).collect()]
    assert not [g for g in got if g[0].startswith("clean")]
    assert set(DETECTORS) == set(synth.INJECTORS) and len(DETECTORS) == 22
    for name, at in truth.items():
        kind = name.rpartition("-")[0]
        assert (name, kind, at) in got, (name, at, [g for g in got if g[0] == name])


def test_substring_provenance_and_required_keys(spark):
    goal, steps = synth.clean_run(5)
    tool = next(i for i, s in enumerate(steps) if s["kind"] == "tool")
    steps[tool]["payload"]["arguments_json"] = '{"a": "v2.7-b, zz-1", "b": [{"c": "new\\u0031x9 old77"}], "k-99x": "plain"}'
    steps[tool - 1]["payload"]["response_messages"] = [{"role": "assistant", "content": None}, {"role": "assistant", "content": "about xv2.7-bx and OLD77"}]
    ok = steps[-1]["payload"]
    ok["response_format_schema"], ok["response_messages"] = '{"required": ["v"]}', [{"role": "assistant", "content": ""}, {"role": "assistant", "content": '{"v": 1}'}]
    got = sorted((r.detector, r.step_index) for r in signals(enrich(*synth.tables(spark, {"t": (goal, steps, "success")})), ["parameter_drift", "output_schema_violation"]).collect())
    assert got == [("parameter_drift", tool)] and tool == 3  # only new1x9; zz-1 is too short
