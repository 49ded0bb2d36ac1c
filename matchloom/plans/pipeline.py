"""The whole flow: spaces, summaries, embeddings, candidates, quality, exclusions, final table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from matchloom.config import Config, load_preset
from matchloom.operators import assemble, matching, models, patients, trials
from matchloom.sources.staging import checkpointed


@dataclass
class MatchingPipeline:
    """Models default to the offline expressions, so a run is deterministic."""

    config: Config = field(default_factory=load_preset)
    trial_model: models.Generator | None = None
    patient_model: models.Generator | None = None
    k: int = 20

    def run(self, trial_table: DataFrame, notes: DataFrame, existing_summaries: DataFrame | None = None, as_of=None) -> DataFrame:
        """Ranked matches of patients with trials. Model outputs are checkpointed, so that a lost executor does not run models again."""
        spaces = checkpointed(trials.summarize_trials(trial_table, config=self.config, generate=self.trial_model))
        summaries = checkpointed(patients.summarize_patients(notes, config=self.config, existing_summaries=existing_summaries, generate=self.patient_model, as_of=as_of))
        found = matching.candidates(matching.embed_for_matching(summaries, entity_type="patient"), matching.embed_for_matching(spaces, entity_type="trial"), k=self.k)
        pairs = assemble.with_context(found, summaries, spaces)
        scored = matching.score_match_quality(pairs.withColumn("_raw", F.col("similarity_score") * 4 - 2), raw="_raw", config=self.config)
        scored = scored.join(spaces.select("space_trial_id", "trial_id"), "space_trial_id")
        exclusions = matching.check_exclusions(assemble.exclusion_pairs(scored, summaries, spaces))
        return assemble.final_matches(scored, exclusions, summaries, spaces, trial_table)
