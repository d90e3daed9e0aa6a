x290