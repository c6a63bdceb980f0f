"""Write PLANS.md: physical plans of the headline queries (for review).

usage: python tests/explain_plans.py [sf_dir]
"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stayframe.operators import asof as A  # noqa: E402
from stayframe.plans import registry_cohort as RC  # noqa: E402
from stayframe.plans import registry_table as RT  # noqa: E402
from stayframe.session import local_session  # noqa: E402

NAMES = [(RC, "p08_apply_inclusion"), (RC, "j08_asof_latest_prior"), (RC, "j09_all_features"),
         (RC, "a04_conditional_max"), (RT, "t01_stratified_split"), (RT, "k06_classification_report")]


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(8)
    out = ["# Physical plans of the headline queries", "",
           f"Generated by `python tests/explain_plans.py {sf}`. Steps that end in a checkpoint appear as a scan of the",
           "checkpointed RDD; the as-of step's written passes (hot-bucket list, event pass) are shown before it.", ""]
    written = []
    write = A._materialize

    def record(df):
        written.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    A._materialize = record   # the passes of the as-of step, before they are written
    for mod, name in NAMES:
        written.clear()
        df = getattr(mod, name)(spark, sf)
        out += [f"## {name}", ""]
        for k, plan in enumerate(written):
            out += [f"Written pass {k + 1}:", "", "```", plan.strip(), "```", ""]
        out += ["Result:", "", "```", df._jdf.queryExecution().executedPlan().toString().strip(), "```", ""]
    open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w").write("\n".join(out))


if __name__ == "__main__":
    main()
