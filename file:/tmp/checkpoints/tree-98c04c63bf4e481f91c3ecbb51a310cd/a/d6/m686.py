x686