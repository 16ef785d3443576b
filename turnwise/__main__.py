"""python -m turnwise list | run NAME SF_DIR [OUT] | chat ITEMS.json [SETTING]"""

import sys

from pyspark.sql import SparkSession


def session() -> SparkSession:
    spark = SparkSession.builder.appName("turnwise").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(args: list[str]) -> int:
    from .plans import catalog

    match args:
        case ["list"]:
            print(*sorted(catalog.QUERIES), sep="\n")
        case ["run", name, sf_dir, *out] if name in catalog.QUERIES:
            df = catalog.QUERIES[name](session(), sf_dir)
            df.write.mode("error").parquet(out[0]) if out else df.show(50, truncate=False)
        case ["chat", path, *setting]:
            from .operators import dialogue
            from .sources import files

            rows = files.read_items(session(), path, *setting).collect()
            inv = dialogue.Inventory([{**r.asDict(), "attributes": dict(r.attributes or {}), "aliases": list(r.aliases or [])} for r in rows])
            said: list[str] = []
            for line in sys.stdin:
                said.append(line.strip())
                turns = dialogue.session(said, inv)
                print(turns[-1]["reply"] if len(turns) == len(said) else "This request is closed.", flush=True)
        case _:
            print(__doc__)
            return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
