"""posewright: motion-clip and vector deduplication, similarity and analysis as DataFrame functions."""
