x830