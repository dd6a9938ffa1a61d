"""cloakframe: sensitive-span detection, arbitration, reversible masking and scoring as Spark jobs."""
