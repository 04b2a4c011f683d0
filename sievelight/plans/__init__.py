"""Decision plans: policies that fold a document's detections, packs, reports."""
