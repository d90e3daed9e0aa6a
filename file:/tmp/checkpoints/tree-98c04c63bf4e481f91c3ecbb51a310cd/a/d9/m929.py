x929