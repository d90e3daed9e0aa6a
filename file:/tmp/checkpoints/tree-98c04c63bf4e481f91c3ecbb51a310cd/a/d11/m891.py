x891