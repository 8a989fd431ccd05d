"""The external ancestral reconstruction: its command lines, its run, and finding its outputs."""

from __future__ import annotations

import shutil
import subprocess
from pathlib import Path

from pyspark.sql import SparkSession

from twigmer.plans.settings import BuildParams
from twigmer.sources.storage import list_files

# Arguments and output names of the two tools.
RAXML_FIXED = ["--precision", "9", "--seed", "1", "--force", "msa", "--redo"]
RAXML_MODEL = ["--blopt", "nr_safe", "--opt-model", "on", "--opt-branches", "on"]
PHYML_FIXED = ["--ancestral", "--no_memory_check", "--leave_duplicates"]
OUTPUTS = {"raxml-ng": (".raxml.ancestralProbs", ".raxml.ancestralTree"), "phyml": ("_phyml_ancestral_seq.txt", "_phyml_ancestral_tree.txt")}


def find_binary(name: str = "raxml-ng") -> str:
    if (found := shutil.which(name)) is None:
        raise FileNotFoundError(f"{name} isn't in PATH")
    return found


def guess_tool(help_text: str) -> str:
    """The tool that a binary's help text names first."""
    for line in help_text.lower().splitlines():
        for tool in OUTPUTS:
            if tool in line:
                return tool
    raise ValueError("not a known reconstruction tool")


def command(tool: str, binary: str, alignment: str, tree: str, params: BuildParams, threads: int = 1, arguments: list[str] | None = None) -> list[str]:
    """The call; ``arguments`` (from a configuration file) take the place of those for the model."""
    if tool == "raxml-ng":
        own = arguments or ["--model", f"{params.model}+G{params.categories}{{{params.alpha}}}+IU{{0}}+FC", *RAXML_MODEL]
        return [binary, "--ancestral", "--msa", alignment, "--tree", tree, "--threads", str(threads), *RAXML_FIXED, *own]
    own = arguments or ["-m", str(params.model), "-c", str(params.categories), "-a", str(params.alpha), "-b", "0", "-v", "0.0", "-o", "r", "-f", "e"]
    return [binary, *PHYML_FIXED, "-i", alignment, "-u", tree, *own]


def run(binary: str, alignment: str, tree: str, params: BuildParams, threads: int = 1, arguments: list[str] | None = None) -> tuple[str, str]:
    """Run the tool on the driver; the paths of its probabilities and its tree, which have to be there and not empty."""
    said = subprocess.run([binary, "--help"], capture_output=True, text=True, check=False)
    tool = guess_tool(said.stdout + said.stderr)
    subprocess.run(command(tool, binary, alignment, tree, params, threads, arguments), check=True)
    found = tuple(alignment + suffix for suffix in OUTPUTS[tool])
    for path in found:
        if not Path(path).is_file() or not Path(path).stat().st_size:
            raise FileNotFoundError(f"{tool} left no {path}")
    return found


def find_outputs(spark: SparkSession, folder: str) -> tuple[str, str, str]:
    """The tool and the paths of probabilities and tree in a folder of earlier results, on any file system."""
    files = list_files(spark, folder)
    for tool, suffixes in OUTPUTS.items():
        found = [next((p for p in files if p.endswith(s)), None) for s in suffixes]
        if all(found):
            return tool, *found
    raise FileNotFoundError(f"no reconstruction results in {folder}")
