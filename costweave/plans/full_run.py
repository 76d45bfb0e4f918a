"""Raw tables to clean tables to a trained state."""

from __future__ import annotations

from costweave.operators.cleanse import clean_projects
from costweave.operators.normalize import clean_cpi, clean_subsystems
from costweave.plans import training
from costweave.sources import tables
from costweave.sources.state import TrainingState


def run_all(
    spark, raw_projects: str, raw_subsystems: str, raw_cpi: str, out_folder: str, fit: training.Fit
) -> TrainingState:
    """Clean both tables, store them, then train on the stored projects.

    Writes clean_projects, clean_subsystems and the training state below out_folder.
    """
    projects = clean_projects(tables.read_raw_projects(spark, raw_projects))
    tables.write_table(projects, f"{out_folder}/clean_projects")
    cpi = clean_cpi(tables.read_raw_cpi(spark, raw_cpi))
    subsystems = clean_subsystems(tables.read_raw_subsystems(spark, raw_subsystems), cpi)
    tables.write_table(subsystems, f"{out_folder}/clean_subsystems")
    return training.run(spark, f"{out_folder}/clean_projects", f"{out_folder}/state", fit)
