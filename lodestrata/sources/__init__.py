"""Sources and sinks: images, feedback documents, run artefacts."""
