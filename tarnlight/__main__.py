"""``python -m tarnlight <job> --config file.yaml [--set key=value]``."""

from __future__ import annotations

import argparse
import urllib.request
from pathlib import Path

from tarnlight.plans.jobs import JOBS
from tarnlight.session import get_session
from tarnlight.sources import readers, sinks


def _get(url: str) -> str:
    with urllib.request.urlopen(url, timeout=60) as answer:
        return answer.read().decode("utf-8", "replace")


def fetch_rates(spark, config: dict) -> str:
    """Downloads every configured series once: ``url`` has ``{id}``, ``series`` maps corridors to ids."""
    df = readers.fetch_snapshot(spark, lambda cbr_id: _get(config["url"].format(id=cbr_id)), config["series"], config["rates"], bool(config.get("force")))
    Path(config["download"]).mkdir(parents=True, exist_ok=True)
    sinks.manifest(df, config["rates"], f"{config['download']}/manifest.json", url=config["url"])
    return f"{df.count()} rates at {config['rates']}\n"


def fetch_context(spark, config: dict) -> str:
    """Downloads public CSV series into one long panel; each names its date and value columns and its lag."""
    out = None
    for s in config["public_sources"]:
        file = Path(config["download"], f"{s['name']}.csv")
        file.parent.mkdir(parents=True, exist_ok=True)
        if config.get("force") or not file.exists():
            file.write_text(_get(s["url"]), encoding="utf-8")
        one = readers.public_context_csv(spark, str(file), s["date_column"], s["value_column"], s["name"], s["url"], int(s["availability_lag_days"]))
        out = one if out is None else out.unionByName(one)
    sinks.write_table(out, config["public_context"])
    return f"context at {config['public_context']}\n"


def fetch_external(spark, config: dict) -> str:
    """The public context in the external-series shape, with its contract checked."""
    fetch_context(spark, config)
    external = readers.validate_external(readers.from_public_context(spark.read.parquet(config["public_context"]), config.get("source", "public")))
    sinks.write_table(external, config["external"])
    return f"external series at {config['external']}\n"


COMMANDS = {"fetch": fetch_rates, "fetch-context": fetch_context, "fetch-external": fetch_external, **JOBS}


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tarnlight", description=__doc__)
    parser.add_argument("job", choices=sorted(COMMANDS))
    parser.add_argument("--config", required=True)
    parser.add_argument("--set", action="append", default=[], metavar="KEY=VALUE", help="override a configuration value")
    given = parser.parse_args(args)
    config = readers.load_yaml(given.config) | dict(x.split("=", 1) for x in given.set)
    print(COMMANDS[given.job](get_session(), config), end="")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
