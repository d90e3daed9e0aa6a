x835