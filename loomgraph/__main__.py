"""``python -m loomgraph``: one request to a saved session, answered as JSON."""

import argparse
import json

from pyspark.sql import SparkSession

from .plans import PLANS, SessionRegistry
from .sources import to_json_objects
from .subjects import Subject


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="loomgraph", description=__doc__)
    parser.add_argument("route", choices=["chat", "subjects_info", "tasks_info", "metrics_info", "put_state", "get_state"])
    parser.add_argument("--user", default="user")
    parser.add_argument("--plan", default="Chat", choices=sorted(PLANS))
    parser.add_argument("--table", action="append", default=[], metavar="NAME=PATH", help="a Parquet table for the tools of ToolChat")
    parser.add_argument("--path", required=True, help="folder of the saved sessions")
    parser.add_argument("--data", default="{}", help="JSON: content, subject_name, text (CSV), how, format")
    given = parser.parse_args(args)
    data = json.loads(given.data)
    spark = SparkSession.builder.getOrCreate()
    registry = SessionRegistry(spark, given.path)
    tables = [Subject(name, spark.read.parquet(path)) for name, path in (x.split("=", 1) for x in given.table)]
    session = registry.session(given.user, given.plan, **({"tables": tables} if given.plan == "ToolChat" else {}))
    try:
        session = registry.read(given.user, given.plan)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    subject = data.get("subject_name", "messages")
    if given.route == "chat":
        rows = session.spark.createDataFrame([("user", data["content"], "")], "role string, content string, timestamp string")
        said = session.run(subject, rows)
        print(json.dumps([x for made in said for m in made.values() for x in to_json_objects(m.df)]))
    elif given.route == "put_state":
        session.put_csv(subject, data["text"], data.get("how", "extend"))
    elif given.route == "get_state":
        print(session.get_csv(subject) if data.get("format", "json_obj") == "csv_str" else json.dumps(session.get_json(subject)))
    else:
        table = {"subjects_info": session.subjects, "tasks_info": session.tasks_info, "metrics_info": session.metrics_info}[given.route]()
        print(json.dumps(to_json_objects(table)))
    if given.route in ("chat", "put_state"):
        registry.write(given.user, given.plan)


if __name__ == "__main__":
    main()
