"""Text guardrails at table scale: detections, masks, verdicts, retrieval and metrics as Spark expressions."""
