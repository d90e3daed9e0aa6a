x361