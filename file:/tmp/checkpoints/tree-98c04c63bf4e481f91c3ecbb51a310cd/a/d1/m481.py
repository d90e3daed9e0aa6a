x481