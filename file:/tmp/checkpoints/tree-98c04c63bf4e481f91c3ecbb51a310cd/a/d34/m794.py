x794