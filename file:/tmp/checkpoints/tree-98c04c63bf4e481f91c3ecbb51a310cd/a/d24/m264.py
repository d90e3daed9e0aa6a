x264