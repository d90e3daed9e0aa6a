x983