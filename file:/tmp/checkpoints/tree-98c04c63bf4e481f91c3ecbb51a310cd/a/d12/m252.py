x252