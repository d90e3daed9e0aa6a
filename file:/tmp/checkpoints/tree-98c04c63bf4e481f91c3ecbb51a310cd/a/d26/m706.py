x706