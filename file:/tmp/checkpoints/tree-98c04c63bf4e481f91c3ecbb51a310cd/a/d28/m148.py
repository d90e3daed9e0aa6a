x148